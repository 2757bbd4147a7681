"""Best-fit packing of whole documents after dominance reduction.

Documents become token ids, an end id closes each. Only a document longer than ``CAPACITY`` is cut, into pieces of exactly that size behind
a first one that may be shorter, so each document leaves at most one piece that does not fill a sequence. How these are put
together follows from the count of pieces by length alone (``bin_plan``): sets of one to three lengths that dominate all others with their
largest one are fixed for good, whole batches at once; what is left goes in by best fit, the longest first. The plan is a table of bins by
their lengths (a few thousand rows at most, since there are ``CAPACITY`` lengths), so it is made on the driver and told to all tasks.

Pieces find their places without meeting: each has a number among its task's pieces of its length, counts by length and
task give each task's first number, and the plan tells for each number of a length its sequence and offset. No task gathers the
pieces of a length, however many documents are alike.

Token ids are those of the tokenizer file (byte-level BPE); its vocabulary is put into a faster encoder that gives the same ids
(tested), and texts that may hold a special token, or white space without end, go through the file's own tokenizer. Null text is an empty
document: its end id alone. Repeated rows are packed each; extra columns are ignored. Sequence numbers depend on how the rows are dealt.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from linkweave.llm.bin_plan import Plan, planned
from linkweave.llm.common import cut

CAPACITY = 1024
END_ID = 2
#: Rows that a task tokenizes together.
ROWS = 64
#: Texts with so much white space in one run go through the file's own tokenizer: the encoder's regular expressions would overflow.
GAP = 10_000

# Fixed value: how byte-level BPE parts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands: printable ones themselves, the others letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """Ids of texts as little-endian unsigned 32-bit bytes, for the byte-level BPE file at ``path``."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.gap = re.compile(r"\s{%d}" % GAP)
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.fast = tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks={bytes(letters[c] for c in t): i for t, i in vocab.items()}, special_tokens={})

    def encode(self, text: str) -> bytes:
        if "<|" not in text and (len(text) < GAP or not self.gap.search(text)):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_kept: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """The Ids of this worker process for a file."""
    if path not in _kept:
        _kept[path] = Ids(path)
    return _kept[path]


def pieces_of(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, number): ``number`` counts the task's pieces of one length."""
    documents = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = ids_of(tokenizer_path), np.array([END_ID], "<u4").tobytes()
        task, met = TaskContext.get().partitionId(), [0] * (CAPACITY + 1)
        for whole in batches:
            for batch in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                rows = []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    raw = ids.encode(text or "") + end
                    n = len(raw) // 4
                    start, stop = 0, (n - 1) % CAPACITY + 1
                    for piece in range(-(-n // CAPACITY)):
                        length = stop - start
                        rows.append((i, piece, start, length, zlib.crc32(raw[4 * start : 4 * stop]), task, met[length]))
                        met[length] += 1
                        start, stop = stop, stop + CAPACITY
                at, *made = zip(*rows)
                kinds = [pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *map(pa.array, made, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"])

    longs = ["start", "length", "ids_crc32", "task", "number"]
    schema = T.StructType([documents.schema["doc_id"], T.StructField("piece", T.IntegerType()), *[T.StructField(x, T.LongType()) for x in longs]])
    return documents.mapInArrow(run, schema)


def slots(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, each, bin, at): pieces numbered from ``low`` to before ``high`` of a length fill bins from ``bin`` on, ``each``
    of them a bin, from offset ``at``."""
    rows, used, first = [], {}, 0
    for lengths, times in sorted(plan.items()):
        at = 0
        for length in sorted(set(lengths), reverse=True):
            each, low = lengths.count(length), used.get(length, 0)
            used[length] = low + each * times
            rows.append((length, low, used[length], each, first, at))
            at += each * length
        first += times
    return rows


def pack_documents(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(pieces_of(documents, tokenizer_path))
    short = pieces.filter(F.col("length") < CAPACITY)
    counts = cut(short.groupBy("length", "task").agg(F.count("*").alias("n")))
    plan = planned({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, CAPACITY)
    told = documents.sparkSession.createDataFrame(slots(plan), "of long, low long, high long, each long, bin long, at long")
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    first = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("first"))
    short = short.join(first, ["length", "task"]).withColumn("g", F.col("first") + F.col("number"))
    short = short.join(F.broadcast(told), (F.col("length") == F.col("of")) & F.col("g").between(F.col("low"), F.col("high") - 1))
    place = F.col("g") - F.col("low")
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    short = short.select(*out, (F.col("bin") + F.expr("(g - low) div each")).alias("sequence_id"), (F.col("at") + place % F.col("each") * F.col("length")).alias("offset"))
    full = pieces.filter(F.col("length") == CAPACITY)
    return short.unionByName(full.select(*out, (F.shiftleft(F.col("task") + 1, 40) + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
