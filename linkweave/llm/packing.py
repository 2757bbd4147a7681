"""Packing: harmonic classes of reciprocal capacity, each bin holding a fixed number of documents.

Documents become token ids, an end id closes each. Whole sequences of ``CAPACITY`` tokens are cut off long ones; what is left, or
a whole shorter document, has length n and goes to class m where CAPACITY/(m+1) < n <= CAPACITY/m. A bin of class m
takes exactly m of them, uncut, and never waits for another class, so every worker fills the bins of its own partition. The last
class holds documents of CAPACITY/``CLASSES`` tokens or less: they are the stock from which the gap of a full bin is
filled, the last of them cut at the bin's end; a surplus of stock makes sequences of its own. Where the stock is
empty, the gap waits for the next document, which gives its first tokens. So a sequence costs one cut or none.
At a partition's end the open bins are put together in the same way, and the last tokens are closed as sequences of falling
powers of two, which need no padding.

Tokens: the tokenizer file is a parameter. Its result for a text is the concatenation of its results for the text's words,
so each worker process keeps the ids of words that it has met (``CACHE_WORDS`` at most, then it starts anew); texts that hold
anything but printable Latin characters, or may hold a special token, go through the tokenizer whole.

Null text is an empty document: its end id alone. Repeated rows are packed each; extra columns are ignored. Sequence ids are
unique and depend on the partition, so they may differ between runs over differently split inputs.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from linkweave.llm.common import exact_id

CAPACITY = 2048
END_ID = 1
#: Classes by length, the last of which is stock; and sequences' worth of stock that a task keeps.
CLASSES, STOCK = 16, 4
CACHE_WORDS = 300_000
#: Rows that a task tokenizes together; besides these it keeps open bins (a sequence's worth of each class) and stock.
ROWS = 64

_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
WORDS = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^\\s{_L}{_N}]+")
UNUSUAL = re.compile("[^\\n\\t\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\u012f\\u0132-\\u024f]|<\\|")
_USUAL = b"\n\t\r" + bytes(range(0x20, 0x7F)) + bytes(range(0xA1, 0xAD)) + bytes(range(0xAE, 0x100))

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def is_plain(text: str) -> bool:
    """Whether a text's ids are the concatenation of its words' ids by WORDS."""
    try:
        return not text.encode("latin-1").translate(None, _USUAL) and "<|" not in text
    except UnicodeEncodeError:
        return UNUSUAL.search(text) is None and unicodedata.is_normalized("NFC", text)


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit bytes, for the tokenizer file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.seen: dict[str, bytes] = {}
        last = {i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")}
        self.closes = np.array([i in last for i in range(max(last, default=-1) + 1)])

    def learn(self, words: list[str]) -> None:
        """Keeps the ids of new words: many go through the tokenizer as one text and part at word-closing ids."""
        for at in range(0, len(words), 500):
            some = words[at : at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.closes[np.minimum(ids, len(self.closes) - 1)]) + 1).tolist() if len(self.closes) else []
            if len(stops) == len(some) and stops[-1] == len(ids):
                raw = ids.tobytes()
                self.seen.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(some, [0, *stops], stops))
            else:
                self.seen.update((w, self.whole(w)) for w in some)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [is_plain(t) for t in texts]
        words = [WORDS.findall(t.lower()) if ok else [] for t, ok in zip(texts, plain)]
        if len(self.seen) > CACHE_WORDS:
            self.seen = {}
        self.learn(sorted(set().union(*words).difference(self.seen)))
        ids = self.seen.__getitem__
        return [b"".join(map(ids, found)) if ok else self.whole(t) for t, ok, found in zip(texts, plain, words)]


_kept: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """The Tokens of this worker process for a file: word ids that earlier tasks met are kept."""
    if path not in _kept:
        _kept[path] = Tokens(path)
    return _kept[path]


@dataclass
class Piece:
    """Ids ``raw`` (4 bytes each) of a document from its id ``start`` on; ``doc``: (doc_id, number of ids)."""

    doc: tuple
    start: int
    raw: bytes

    def __len__(self) -> int:
        return len(self.raw) // 4

    def parted(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.raw[: 4 * n]), Piece(self.doc, self.start + n, self.raw[4 * n :])


class Packer:
    """Bins of one partition. Its methods return the rows of sequences that they close."""

    def __init__(self, first: int):
        self.next = first
        self.bins: dict[int, list[Piece]] = {}
        self.waiting: list[Piece] = []  # a bin that has its documents, and a gap
        self.stock: list[Piece] = []

    def close(self, pieces: list[Piece]) -> list[tuple]:
        out, at = [], 0
        for p in pieces:
            out.append((p.doc[0], p.start, len(p), zlib.crc32(p.raw), p.doc[1], self.next, at))
            at += len(p)
        self.next += 1
        return out

    def filled(self, pieces: list[Piece], stock: list[Piece]) -> list[tuple]:
        """Closes ``pieces`` with stock in the gap, or lets them wait."""
        gap = CAPACITY - sum(map(len, pieces))
        while gap and stock:
            p = stock.pop()
            if len(p) > gap:
                p, rest = p.parted(gap)
                stock.append(rest)
            pieces.append(p)
            gap -= len(p)
        if not gap:
            return self.close(pieces)
        self.waiting = pieces
        return []

    def add(self, doc_id: object, raw: bytes) -> list[tuple]:
        rest, out = [Piece((doc_id, len(raw) // 4), 0, raw)], []
        if self.waiting:
            pieces, self.waiting = self.waiting, []
            out += self.filled(pieces, rest)
        if not rest:
            return out
        p = rest.pop()
        while len(p) >= CAPACITY:
            whole, p = p.parted(CAPACITY)
            out += self.close([whole])
        if not len(p):
            return out
        m = CAPACITY // len(p)
        if m >= CLASSES:
            self.stock.append(p)
            if sum(map(len, self.stock)) >= STOCK * CAPACITY:
                out += self.filled([], self.stock)
            return out
        held = self.bins.setdefault(m, [])
        held.append(p)
        return out + (self.filled(self.bins.pop(m), self.stock) if len(held) == m else [])

    def rest(self) -> list[tuple]:
        left = self.waiting + [p for _, held in sorted(self.bins.items()) for p in held] + self.stock
        left.reverse()
        self.bins, self.stock, self.waiting, out = {}, [], [], []
        while left:
            out += self.filled([], left)
        tail, self.waiting = list(reversed(self.waiting)), []
        size = sum(map(len, tail))
        while size:
            n = gap = 1 << size.bit_length() - 1
            pieces = []
            while gap:
                p = tail.pop()
                if len(p) > gap:
                    p, more = p.parted(gap)
                    tail.append(more)
                pieces.append(p)
                gap -= len(p)
            out += self.close(pieces)
            size -= n
        return out


def pack_documents(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (see SCHEMA)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = tokens_of(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 40)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        end = np.array([END_ID], "<u4").tobytes()
        for p in parts:
            for at in range(0, len(p), ROWS):
                q, out = p.iloc[at : at + ROWS], []
                for doc_id, raw in zip(q["doc_id"], tokens.encode([t or "" for t in q["text"]])):
                    out += packer.add(doc_id, raw + end)
                if out:
                    yield pd.DataFrame(out, columns=names)
        if out := packer.rest():
            yield pd.DataFrame(out, columns=names)

    rows = documents.select(exact_id("doc_id"), "text").mapInPandas(run, SCHEMA.replace("doc_id long", "doc_id string"))
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
