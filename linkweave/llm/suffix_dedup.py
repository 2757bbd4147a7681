"""Exact substring dedup: repeats of ``LEAST`` bytes by interval expansion over Burrows-Wheeler transforms.

Removed is every byte of a document that a string of ``LEAST`` bytes covers which also starts in a document with a smaller
doc_id; all is judged on the input. Texts are UTF-8 bytes (null: empty), and no string crosses documents.

A transform of all texts would not fit a task, so strings are dealt to buckets where equal ones must meet, and each
bucket expands intervals over a transform of its own:

1. Each string of ``LEAST`` bytes has an anchor: the ``GRAM`` bytes in it of least hash (the leftmost of equals). Strings
   next to each other share anchors, so a text falls into runs of strings of one anchor. Equal strings have equal
   anchors at equal offsets, hence may only meet under the same anchor.
2. Runs are packed by anchor bucket, with hashes of anchor and run. A run that stands equal in a smaller document is
   removed as a whole. Runs whose anchor recurs in another document in another run are open.
3. The bytes of open runs meet in buckets by anchor. A string holds its anchor and ``REACH`` more bytes to the left or right of
   it, so runs that no other document's run equals on either side are left out; the transform of the others gives all strings
   that start more than once, and with them the smallest document of each. An anchor with more than ``HOT_IN_BATCH`` different runs in one batch of documents, or ``HOT`` in all, is not gathered: its strings
   are hashed (128 bits), aggregated to the smallest document, and joined back.

Rows with a null doc_id are kept whole and remove nothing. Rows that repeat a doc_id count as one document; each keeps its
own text. Equal runs are told by hashes of
88 bits and more. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from linkweave.llm import bwt
from linkweave.llm.common import cut, exact_id, removed, shared_dir
from linkweave.llm.shingles import mixed, powers

LEAST, GRAM = 50, 16
REACH = (LEAST - GRAM) // 2
#: A scan works on about so many bytes of text at a time (arrays that fit a core's cache); longer texts go in pieces.
CHUNK_BYTES, PIECE_BYTES = 1 << 17, 1 << 20
RUNS_PER_BUCKET = 1_000_000
BUCKET_BYTES = 1 << 20
#: Different runs of one anchor in a batch, and in all, above which it is not gathered in a bucket.
HOT_IN_BATCH, HOT = 300, 5_000
#: Rows whose runs a task holds together: a batch.
SLICE = 5_000
#: Anchor hashes keep 40 bits besides their bucket, run hashes 48.
ANCHOR_BYTES, BODY_BYTES = 5, 6
#: Cuts go to the last scan by broadcast up to so many (16 bytes each), else by a shuffle join.
BROADCAST_CUTS = 1_000_000
WHOLE, OPEN, SPREAD = 0, 1, 2

_LOW = np.uint64((1 << 24) - 1)


Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def runs(raw: bytes) -> Runs:
    """(start, size, offset, anchor hash, run hash): strings of LEAST bytes that start in [start, start + size) share an
    anchor, which lies ``offset`` bytes after the start."""
    total = len(raw) - LEAST + 1
    found = [piece_runs(raw, low, min(low + PIECE_BYTES, total)) for low in range(0, total, PIECE_BYTES)]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, t) for t in ("i8", "i8", "i8", "u8", "u8"))


def least_keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the GRAM bytes at each place, and for each string its least key (40 bits of hash, 24 of place)."""
    n = len(data) - GRAM + 1
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = np.ascontiguousarray(eight).view(np.uint64).ravel()
    hashes = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    hashes ^= hashes >> np.uint64(32)
    hashes += words[GRAM - 8 : GRAM - 8 + n]
    hashes *= np.uint64(0xC2B2AE3D27D4EB4F)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0x165667B19E3779F9)
    keys = (hashes & ~_LOW) | np.arange(n, dtype=np.uint64)
    width, span = LEAST - GRAM + 1, 1
    while 2 * span <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    if width > span:
        keys = np.minimum(keys[: span - width], keys[width - span :])
    return hashes, keys


def run_bounds(keys: np.ndarray, edges: np.ndarray | None = None) -> np.ndarray:
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if edges is not None:
        new[edges] = True
    return np.flatnonzero(new)


def range_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte ranges."""
    p, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
    return (sums[stop] - sums[start]) * inverse[start]


def described(data: np.ndarray, hashes: np.ndarray, keys: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Runs:
    """The run hash covers the run's bytes, its length and its anchor's offset."""
    anchor = (keys[start] & _LOW).astype(np.int64)
    end = stop + LEAST - 1
    shape = mixed((end - start).astype(np.uint64) * np.uint64(1 << 20) + (anchor - start).astype(np.uint64))
    return start, stop - start, anchor - start, mixed(hashes[anchor]), mixed(range_hashes(data, start, end) + shape)


def piece_runs(raw: bytes, low: int, high: int) -> Runs:
    data = np.frombuffer(raw, np.uint8, high - low + LEAST - 1, low)
    hashes, keys = least_keys(data)
    start = run_bounds(keys)
    start, *rest = described(data, hashes, keys, start, np.append(start[1:], len(keys)))
    return start + low, *rest


def all_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """``runs`` of all texts, some texts at a time, each with its text's number (``owner``) in front."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK_BYTES):
            size += len(texts[stop])
            stop += 1
        if stop == at + 1:
            found = runs(texts[at])
            yield np.full(len(found[0]), at), *found
        elif size >= LEAST:
            lengths = np.array([len(x) for x in texts[at:stop]])
            base = np.cumsum(lengths) - lengths
            data = np.frombuffer(b"".join(texts[at:stop]), np.uint8)
            hashes, keys = least_keys(data)
            start = run_bounds(keys, base[base < len(keys)])
            owner = np.searchsorted(base, start, side="right") - 1
            end = np.minimum(np.append(start[1:], len(keys)), base[owner] + lengths[owner] - LEAST + 1)
            good = end > start
            start, end, owner = start[good], end[good], owner[good]
            start, *rest = described(data, hashes, keys, start, end)
            yield owner + at, start - base[owner], *rest
        at = stop


def utf8(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts]


#: What is told of a run, by kind: its document and place, and for runs still to be compared its anchor.
_PLACE = [("doc", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("size", "u1")]
TOLD = {WHOLE: np.dtype(_PLACE), OPEN: np.dtype([*_PLACE, ("offset", "u1"), ("anchor", "<u8")]), SPREAD: np.dtype(_PLACE)}


def told(kind: int, groups: int, **columns: np.ndarray) -> dict:
    """One row per group of documents (doc_id modulo ``groups``): its runs of a kind, by document and place."""
    group = np.mod(columns["doc"], groups)
    order = np.lexsort((columns["start"], columns["tag"], columns["doc"], group))
    group = group[order]
    rows = np.empty(len(group), TOLD[kind])
    for name in TOLD[kind].names:
        rows[name] = columns[name][order]
    at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ends = np.append(at[1:], len(group))
    return {"g": group[at].astype(np.int32), "kind": np.full(len(at), kind, np.int32), "runs": [rows[a:b].tobytes() for a, b in zip(at, ends)]}


FOUND = "g int, kind int, runs binary"


def grouped(anchor: np.ndarray, body: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Order by anchor, then body and doc; only anchors that occur again need the finer sort."""
    order = np.argsort(anchor)
    a = anchor[order]
    same = np.zeros(len(a), bool)
    same[1:] = a[1:] == a[:-1]
    same[:-1] |= same[1:]
    some = order[same]
    order[same] = some[np.lexsort((doc[some], body[some], anchor[some]))]
    return order


def packed_runs(documents: DataFrame, buckets: int, groups: int) -> DataFrame:
    """Runs of each batch, packed by bucket; rows with bucket null in ``blob`` are decided within the batch (see FOUND)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in (q.iloc[at : at + SLICE] for q in parts for at in range(0, len(q), SLICE)):
            found = list(all_runs(utf8(p["text"])))
            if not found:
                continue
            own, start, size, offset, anchor, body = (np.concatenate(x) for x in zip(*found))
            del found
            if not len(own):
                continue
            doc, tag = p["doc_id"].to_numpy(np.int64)[own], p["tag"].to_numpy(np.int64)[own]
            order = grouped(anchor, body, doc)
            start, size, offset, anchor, body, doc, tag = (x[order] for x in (start.astype(np.uint32), size.astype(np.uint8), offset.astype(np.uint8), anchor, body, doc, tag))
            new_anchor = np.append(True, anchor[1:] != anchor[:-1])
            new_run = new_anchor | np.append(True, body[1:] != body[:-1])
            later = doc != doc[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
            number = np.cumsum(new_anchor) - 1
            hot = (np.bincount(number, weights=new_run) > HOT_IN_BATCH)[number]
            for kind, chosen in ((WHOLE, later), (SPREAD, hot & ~later)):
                if chosen.any():
                    yield pd.DataFrame({"bucket": 0, "blob": None} | told(kind, groups, doc=doc[chosen], tag=tag[chosen], start=start[chosen], size=size[chosen]))
            ship = ~later & (~hot | new_anchor)  # of a hot anchor one run stands for all, marked
            bucket = ((anchor[ship] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            columns = [x[ship] for x in (start, size, offset, anchor, body, doc, tag, hot)]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))  # anchors are in order, so buckets are
            held = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
            blobs = [packed(*[x[cuts[b] : cuts[b + 1]] for x in columns]) for b in held]
            yield pd.DataFrame({"bucket": held, "blob": blobs, "g": 0, "kind": 0, "runs": None})

    return documents.mapInPandas(run, f"bucket int, blob binary, {FOUND}")


def low_bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low_bytes(raw: memoryview, m: int, n: int) -> np.ndarray:
    out = np.zeros((m, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8, m * n).reshape(m, n)
    return out.view("<u8").ravel()


def packed(start: np.ndarray, size: np.ndarray, offset: np.ndarray, anchor: np.ndarray, body: np.ndarray, doc: np.ndarray, tag: np.ndarray, hot: np.ndarray) -> bytes:
    """Runs sorted by document, so that owners are told by counts."""
    order = np.lexsort((start, tag, doc))
    start, size, offset, anchor, body, doc, tag, hot = (x[order] for x in (start, size, offset, anchor, body, doc, tag, hot))
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))
    counts = np.diff(np.append(first, len(doc))).astype(np.uint32)
    head = np.array([len(first), len(doc)], np.int64)
    small = [x.tobytes() for x in (head, doc[first], tag[first], counts, start, size, offset, hot.astype(np.uint8))]
    return b"".join([*small, low_bytes(anchor, ANCHOR_BYTES), low_bytes(body, BODY_BYTES)])


def unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
    k, m = np.frombuffer(raw, np.int64, 2).tolist()
    view, at = memoryview(raw), 16

    def take(kind: type, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(view[at : at + n * np.dtype(kind).itemsize], kind)
        at += out.nbytes
        return out

    doc, tag, counts = take(np.int64, k), take(np.int64, k), take(np.uint32, k)
    start, size, offset, hot = take(np.uint32, m), take(np.uint8, m), take(np.uint8, m), take(np.uint8, m)
    anchor = from_low_bytes(view[at:], m, ANCHOR_BYTES)
    body = from_low_bytes(view[at + m * ANCHOR_BYTES :], m, BODY_BYTES)
    return np.repeat(doc, counts), np.repeat(tag, counts), start, size, offset, hot.astype(bool), anchor, body


def decided(blobs: list[bytes], groups: int) -> Iterator[pd.DataFrame]:
    """FOUND rows of one bucket."""
    columns = [np.concatenate(x) for x in zip(*map(unpacked, blobs))]
    blobs.clear()
    order = grouped(columns[6], columns[7], columns[0])
    doc, tag, start, size, offset, hot, anchor, body = (x[order] for x in columns)
    del columns
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])
    new_run = new_anchor | np.append(True, body[1:] != body[:-1])
    number = np.cumsum(new_anchor) - 1
    later = doc != doc[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
    at = np.flatnonzero(new_anchor)
    several = np.bincount(number, weights=new_run)
    mixed_docs = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
    marked = np.logical_or.reduceat(hot, at)
    open_ = ((several > 1) & mixed_docs | marked)[number] & ~later
    spread = open_ & (marked | (several > HOT))[number]
    for kind, chosen in ((WHOLE, later), (OPEN, open_ & ~spread), (SPREAD, spread & ~hot)):  # marked runs were told by their batch
        if chosen.any():
            yield pd.DataFrame(told(kind, groups, doc=doc[chosen], tag=tag[chosen], start=start[chosen], size=size[chosen], offset=offset[chosen], anchor=anchor[chosen]))


def decided_runs(packed_: DataFrame, buckets: int, groups: int) -> DataFrame:
    """By groups of documents and kind: the runs that are removed whole, open, or spread (see FOUND)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, blobs = None, []
        for p in parts:
            direct = p[p["blob"].isna()]
            if len(direct):
                yield direct[["g", "kind", "runs"]]
            for b, raw in zip(p["bucket"].tolist(), p["blob"]):
                if raw is None:
                    continue
                if b != now and blobs:
                    yield from decided(blobs, groups)
                    blobs = []
                now = b
                blobs.append(raw)
        if blobs:
            yield from decided(blobs, groups)

    # rows without a blob stay in the task that made them or go anywhere: the bucket they carry only deals them out
    dealt = packed_.withColumn("bucket", F.when(F.col("blob").isNull(), F.pmod(F.col("g"), F.lit(buckets))).otherwise(F.col("bucket")))
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(run, FOUND)


PARTS = "kind int, key1 long, key2 long, doc_id long, tag long, start long, stop long, piece binary"


def parts_of(documents: DataFrame, found: DataFrame, groups: int) -> DataFrame:
    """Cuts (kind WHOLE: start, stop), open runs (OPEN: key1 anchor, key2 its offset, piece), hashed strings (SPREAD: key1, key2).

    What is told of a group of documents meets their texts in one task: first all of the former, then text by text.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PARTS.split(", ")]
        now, sorted_, by, out = None, False, {}, []
        for p in parts:
            for g, kind, raw, doc_id, tag, text in zip(p["g"].tolist(), p["kind"].tolist(), p["runs"], p["doc_id"].tolist(), p["tag"].tolist(), p["text"]):
                if g != now:
                    now, sorted_, by = g, False, {}
                if raw is not None:
                    by.setdefault(int(kind), []).append(raw)
                    continue
                if not sorted_:
                    by = {k: by_document(np.frombuffer(b"".join(v), TOLD[k])) for k, v in by.items()}
                    sorted_ = True
                tag, data = int(tag), None
                for k, (rows, docs) in by.items():
                    low, high = np.searchsorted(docs, doc_id, "left"), np.searchsorted(docs, doc_id, "right")
                    own = rows[low:high]
                    own = own[own["tag"] == tag]
                    if len(own):
                        data = (text or "").encode("utf-8", "replace") if data is None else data
                        out += parts_of_text(k, np.unique(own), int(doc_id), tag, data)
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    # nulls would turn whole numbers into floating ones on the way to pandas
    nothing = {"kind": F.lit(-1).cast("int"), "runs": F.lit(None).cast("binary"), "doc_id": F.lit(0).cast("long"), "tag": F.lit(0).cast("long"), "text": F.lit(None).cast("string")}
    texts = documents.select(F.pmod(F.col("doc_id"), F.lit(groups)).cast("int").alias("g"), F.lit(1).alias("turn"), nothing["kind"].alias("kind"), nothing["runs"].alias("runs"), "doc_id", "tag", "text")
    runs_ = found.select("g", F.lit(0).alias("turn"), "kind", "runs", *[nothing[c].alias(c) for c in ("doc_id", "tag", "text")])
    return texts.unionByName(runs_).repartition("g").sortWithinPartitions("g", "turn").mapInPandas(run, PARTS)


def by_document(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = rows[np.argsort(rows["doc"], kind="stable")]
    return rows, np.ascontiguousarray(rows["doc"])


def parts_of_text(kind: int, rows: np.ndarray, doc_id: int, tag: int, data: bytes) -> list[tuple]:
    """PARTS rows of one document and kind."""
    start = rows["start"].astype(np.int64)
    if kind == WHOLE:
        return [(WHOLE, 0, 0, doc_id, tag, a, b, None) for a, b in merged(start, start + rows["size"] + (LEAST - 1))]
    if kind == OPEN:
        found = zip(start.tolist(), rows["size"].tolist(), rows["offset"].tolist(), rows["anchor"].astype(np.int64).tolist())
        return [(OPEN, anchor, offset, doc_id, tag, a, a + n, data[a : a + n + LEAST - 1]) for a, n, offset, anchor in found]
    out = []
    for a, n in zip(start.tolist(), rows["size"].tolist()):
        for s in range(a, a + n):
            one, two = np.frombuffer(hashlib.blake2b(data[s : s + LEAST], digest_size=16).digest(), np.int64).tolist()
            out.append((SPREAD, one, two, doc_id, tag, s, s + LEAST, None))
    return out


def merged(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of sorted or unsorted intervals that overlap or touch."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > stop[:-1])
    return list(zip(start[new].tolist(), stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)].tolist()))


CUTS = "doc_id long, tag long, start long, stop long"


def partnered(pieces: list[bytes], anchor: np.ndarray, offset: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether another document's piece has the same anchor and the same REACH bytes to the left or right of it."""
    lengths = np.array([len(x) for x in pieces])
    base = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(pieces), np.uint8)
    at = base + offset
    keep = np.zeros(len(pieces), bool)
    for has, low in ((offset >= REACH, at - REACH), (offset + GRAM + REACH <= lengths, at)):
        i = np.flatnonzero(has)
        if len(i):
            key = mixed(range_hashes(data, low[i], low[i] + GRAM + REACH) + mixed(anchor[i]))
            order = np.argsort(key)
            first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
            d = doc[i][order]
            several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            keep[i[order]] |= np.repeat(several, np.diff(np.append(first, len(i))))
    return keep


def bucket_cuts(p: pd.DataFrame) -> pd.DataFrame | None:
    """Cuts among the open runs of a bucket: strings with a smaller document in their group."""
    doc, tag, base = (p[c].to_numpy(np.int64) for c in ("doc_id", "tag", "start"))
    pieces = p["piece"].tolist()
    keep = np.flatnonzero(partnered(pieces, p["key1"].to_numpy(np.int64).view(np.uint64), p["key2"].to_numpy(np.int64), doc))
    doc, tag, base = doc[keep], tag[keep], base[keep]
    if not len(keep):
        return None
    group, piece, offset = bwt.repeats([pieces[i] for i in keep], LEAST)
    if not len(group):
        return None
    order = np.argsort(group, kind="stable")
    group, piece, offset = group[order], piece[order], offset[order]
    at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    smallest = np.repeat(np.minimum.reduceat(doc[piece], at), np.diff(np.append(at, len(group))))
    late = doc[piece] > smallest
    piece, offset = piece[late], offset[late]
    order = np.lexsort((offset, piece))
    piece, offset = piece[order], offset[order]
    if not len(piece):
        return None
    first = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (offset[1:] > offset[:-1] + LEAST)))
    last = np.append(first[1:] - 1, len(piece) - 1)
    rows = piece[first]
    return pd.DataFrame({"doc_id": doc[rows], "tag": tag[rows], "start": base[rows] + offset[first], "stop": base[rows] + offset[last] + LEAST})


def open_cuts(open_: DataFrame) -> DataFrame:
    """Cuts among open runs, dealt to buckets by anchor."""
    size = open_.agg(F.coalesce(F.sum(F.length("piece")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(12, size // BUCKET_BYTES)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for p in parts:
            for number, q in p.groupby("bucket", sort=True):
                if held and held[0]["bucket"].iat[0] != number:
                    if (out := bucket_cuts(pd.concat(held))) is not None:
                        yield out
                    held = []
                held.append(q)
        if held and (out := bucket_cuts(pd.concat(held))) is not None:
            yield out

    rows = open_.select(F.pmod(F.xxhash64("key1"), F.lit(buckets)).cast("int").alias("bucket"), "key1", "key2", "doc_id", "tag", "start", "piece")
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(run, CUTS)


def spread_cuts(spread: DataFrame) -> DataFrame:
    """Cuts among the hashed strings of hot anchors."""
    first = spread.groupBy("key1", "key2").agg(F.min("doc_id").alias("first"))
    return spread.join(first, ["key1", "key2"]).filter("doc_id > first").select("doc_id", "tag", "start", "stop")


def find_cuts(documents: DataFrame) -> DataFrame:
    """Per document (doc_id, tag = xxhash64 of its text): ``cuts``, the (start, stop) of its maximal byte ranges to remove,
    as packed 64-bit integers."""
    spark = documents.sparkSession
    texts = documents.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("tag"), "text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(12, size // 17 // RUNS_PER_BUCKET)  # a run has 17 strings or so
    groups = 2 * buckets
    found = decided_runs(packed_runs(texts, buckets, groups), buckets, groups)
    folder = shared_dir(spark, "suffix-parts")
    parts_of(texts, found, groups).write.parquet(folder)
    parts = spark.read.schema(PARTS).parquet(folder)
    whole = parts.filter(F.col("kind") == WHOLE).select("doc_id", "tag", "start", "stop")
    every = whole.unionByName(open_cuts(parts.filter(F.col("kind") == OPEN))).unionByName(spread_cuts(parts.filter(F.col("kind") == SPREAD)))
    cuts = every.groupBy("doc_id", "tag").agg(F.collect_list("start").alias("start"), F.collect_list("stop").alias("stop"))

    def union(parts_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts_:
            spans = [np.array(merged(np.asarray(a, np.int64), np.asarray(b, np.int64)), np.int64).tobytes() for a, b in zip(p["start"], p["stop"])]
            yield pd.DataFrame({"doc_id": p["doc_id"], "tag": p["tag"], "cuts": spans})

    out = cut(cuts.mapInPandas(union, "doc_id long, tag long, cuts binary"))
    removed(spark, folder)
    return out


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def with_cuts(documents: DataFrame, columns: list[str]) -> DataFrame:
    """The documents with ``cuts`` (null without any), by broadcast where a count shows that they are few."""
    cuts = find_cuts(documents)
    few = cuts.agg(F.coalesce(F.sum(F.length("cuts")), F.lit(0)).alias("n")).first()["n"] <= 16 * BROADCAST_CUTS
    texts = documents.select(*columns, F.xxhash64("text").alias("tag"))
    return texts.join(F.broadcast(cuts) if few else cuts, ["doc_id", "tag"], "left")


def kept(raw: bytes, cuts: bytes | None) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes went and in how many maximal runs."""
    if not cuts:
        return raw, 0, 0
    gone = np.frombuffer(cuts, np.int64).reshape(-1, 2).tolist()
    left = b"".join(raw[a:b] for a, b in zip([0, *[b for _, b in gone]], [*[a for a, _ in gone], len(raw)]))
    return left, len(raw) - len(left), len(gone)


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for p in parts:
            out = []
            for doc_id, raw, cuts in zip(p["doc_id"], utf8(p["text"]), p["cuts"]):
                left, gone, spans = kept(raw, cuts)
                out.append((doc_id, len(raw), gone, spans, hashlib.sha256(left).hexdigest()))
            yield pd.DataFrame(out, columns=names)

    rows = with_cuts(documents, ["doc_id", "text"]).select(exact_id("doc_id"), "text", "cuts").mapInPandas(run, SCHEMA.replace("doc_id long", "doc_id string"))
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
