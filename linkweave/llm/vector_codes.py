"""Vector codes: product quantization of embeddings, the nearest entries found in trees over the entries.

A component x becomes floor(1024 x); vectors are cut into four equal parts, and each part position has a codebook of up to 256
entries, so the codebooks are a bounded few and go to all tasks. A round is one pass over the vectors: each task finds every part's
nearest entry in a tree (``gnat``) and adds its parts up by entry; the sums of all tasks are added by Spark and give the
next codebooks. All arithmetic is in whole numbers, so results don't depend on how rows are dealt.

Vectors that are null or hold null or non-finite components go. Others are filled up with zeros to the longest one's length, rounded
up to a multiple of four. Components beyond +-2**24 (that is |x| of 16384 and more) count as that bound, so that errors fit
64 bits. The first entries are those of the smallest vec_ids (then the smallest vectors; null ids come last), and each row of a
repeated id counts. Without vectors there are no rows; null labels are one label. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from linkweave.llm.common import cut
from linkweave.llm.gnat import Gnat

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BOUND = 2**24
#: Queries that meet a tree together.
BLOCK = 4096
#: Up to so many labels their sums are told by broadcast; beyond, only those of labels with a thousandth of the rows or more.
BROADCAST_LABELS, SHARE = 100_000, 1000


def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows whose vectors can be coded."""
    e = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return e.filter(F.col("v").isNotNull() & F.coalesce(good, F.lit(False)))


def whole(vectors: pa.Array, dims: int) -> np.ndarray:
    """[row, part, dims] whole numbers of a list array."""
    sizes = np.asarray(vectors.value_lengths(), np.int64)
    out = np.zeros((len(sizes), PARTS * dims), np.int64)
    flat = np.asarray(vectors.flatten(), np.float64)
    flat = np.clip(np.floor(np.clip(flat, -BOUND, BOUND) * SCALE), -BOUND, BOUND).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out.reshape(len(sizes), PARTS, dims)


def coded(batch: pa.RecordBatch, trees: list[Gnat], dims: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows at a time: (rows, [row, part, dims] whole numbers, [row, part] entries, [row, part] squared distances)."""
    for at in range(0, batch.num_rows, BLOCK):
        x = whole(batch.column("v").slice(at, BLOCK), dims)
        found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees)]
        yield slice(at, at + len(x)), x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def moved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks [part, entry, dims] after one round; entries that no part takes stay."""
    parts, entries, dims = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, n, total = [], np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            trees = trees or [Gnat(b) for b in books]
            for _, x, code, _ in coded(batch, trees, dims):
                for p in range(parts):
                    n[p] += np.bincount(code[:, p], minlength=entries)
                    for d in range(dims):
                        total[p, :, d] += np.bincount(code[:, p], x[:, p, d], entries).astype(np.int64)
        p, e = np.nonzero(n)
        if len(p):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * dims, pa.int32()), pa.array(total[p, e].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), lists], ["part", "entry", "n", "total"])

    rows = kept.select("v").mapInArrow(sums, "part long, entry long, n long, total array<long>")
    rows = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(d))) for d in range(dims)]).alias("total")).collect()
    new = books.copy()
    for r in rows:
        new[r["part"], r["entry"]] = [t // r["n"] for t in r["total"]]
    return new


def trained(kept: DataFrame) -> np.ndarray:
    """Codebooks [part, entry, dims] of the vectors; no entries where there are none."""
    width = kept.agg(F.max(F.size("v"))).first()[0] or 0
    dims = -(-width // PARTS)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    books = whole(pa.array([list(r["v"]) for r in first], pa.list_(pa.float64())), dims).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS if len(first) and dims else 0):
        books = moved(kept, books)
    return books


def fingerprint(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def assigned(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of the vectors."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = []
        for batch in batches:
            if batch.num_rows:
                trees = trees or [Gnat(b) for b in books]
                found = [(c, d.sum(1)) for _, _, c, d in coded(batch, trees, books.shape[2])]
                text = np.concatenate([c for c, _ in found]).astype(np.uint8).tobytes().hex()
                text = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text), pa.array(np.concatenate([d for _, d in found]))], ["vec_id", "label", "code", "error"])

    schema = T.StructType([*kept.select("vec_id", "label").schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return kept.mapInArrow(codes, schema)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds ``label_error``: the error summed over equal labels.

    Labels are counted first. Few are told by broadcast; of very many, those that hold a thousandth of the rows or more (a
    thousand at most) still are, so that no hot label meets one task, and the others come by a shuffle.
    """
    sums = cut(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    n, labels = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = sums if labels <= BROADCAST_LABELS else sums.filter(F.col("n") * SHARE >= n)
    out = rows.join(F.broadcast(hot.select(F.col("label").alias("of"), "label_error")), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    if labels <= BROADCAST_LABELS:
        return out
    rest = sums.filter(F.col("n") * SHARE < n).select(F.col("label").alias("of"), F.col("label_error").alias("more"))
    cold = out.filter("label_error is null").drop("label_error").join(rest.hint("shuffle_hash"), F.col("label").eqNullSafe(F.col("of")))
    return out.filter("label_error is not null").unionByName(cold.withColumnRenamed("more", "label_error").drop("of"))


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """Per vector: vec_id, code, error, label_error, codebooks_sha256."""
    kept = valid(embeddings)
    books = trained(kept)
    rows = with_label_error(cut(assigned(kept, books)))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    near = """a{i} AS MATERIALIZED (SELECT vec_id, p, any_value(v) AS v, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT x.vec_id, x.p, x.v, b.e,
 CAST(list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v) AS BIGINT) AS d FROM part x JOIN b{i} b ON b.p = x.p) GROUP BY vec_id, p)"""
    move = """m{i} AS (SELECT p, e, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY 1, 2, 3),
 n{i} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS v FROM m{i} GROUP BY 1, 2),
 b{j} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{i} b LEFT JOIN n{i} n ON n.p = b.p AND n.e = b.e)"""
    rounds = ", ".join(near.format(i=i) + ", " + move.format(i=i, j=i + 1) for i in range(ROUNDS))
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 part AS MATERIALIZED (SELECT vec_id, p, v[CAST(p * (len(v) // 4) + 1 AS BIGINT) : CAST((p + 1) * (len(v) // 4) AS BIGINT)] AS v FROM kept, range(4) t(p)),
 b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),
 {rounds}, {near.format(i=ROUNDS)},
 whole AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1),
 sha AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
 SELECT w.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM whole w JOIN kept k ON k.vec_id = w.vec_id, sha"""


ORACLE = _oracle()
