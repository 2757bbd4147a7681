"""Blocked products of sparse matrices: columns as arrays, blocks of result columns in one task each.

A product's column c is the sum over k of right[k, c] times the left's column k. Result columns are dealt to blocks by hash; a block gets the
left columns that it needs, once each, and makes whole columns, so a column can be pruned and rescaled before anything is
written, and no single product becomes a row. The number of blocks follows from counts: all that a block holds stays
under ``BLOCK_BYTES`` on average, and a matrix with a column too large for that is multiplied by a join instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkweave.operators import transforms as T

BLOCK_BYTES = 128 << 20
#: Bytes of a cell in a block, and cells of one record of a column.
CELL, RECORD = 16, 4096

Column = tuple[np.ndarray, np.ndarray]


def columns_of(cells: DataFrame, largest: int) -> DataFrame:
    """Records (col, rows, vals) of cells; columns of up to ``largest`` cells are split into records of about ``RECORD``."""
    part = F.pmod(F.xxhash64("row"), F.lit(-(-largest // RECORD) or 1))
    held = F.sort_array(F.collect_list(F.struct("row", "val")))
    return cells.groupBy("col", part.alias("part")).agg(held.alias("held")).select("col", F.col("held.row").alias("rows"), F.col("held.val").alias("vals"))


def cells_of(columns: DataFrame) -> DataFrame:
    return columns.select("col", F.explode(F.arrays_zip("rows", "vals")).alias("x")).select("col", F.col("x.rows").alias("row"), F.col("x.vals").alias("val"))


def multiplied(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, Callable[[int], Column]]:
    """(result columns, row ids, f): f(i) gives the i-th column as positions in the row ids and values."""
    left = left.combine_chunks().sort_by("key")
    lists, vals = left.column("rows").combine_chunks(), left.column("vals").combine_chunks()
    sizes = np.asarray(lists.value_lengths(), np.int64)
    rows, flat = np.asarray(lists.flatten()), np.asarray(vals.flatten())
    ids, at = np.unique(rows, return_inverse=True)
    starts, k = np.cumsum(sizes) - sizes, np.asarray(left.column("key"))
    right = right.combine_chunks().sort_by("c")
    c, rk, x = (np.asarray(right.column(n)) for n in ("c", "k", "x"))
    low, high = np.searchsorted(k, rk, "left"), np.searchsorted(k, rk, "right")
    cols, first = np.unique(c, return_index=True)
    last = np.append(first[1:], len(c))
    products = int((np.append(0, np.cumsum(sizes))[high] - np.append(0, np.cumsum(sizes))[low]).sum())
    keys, ki = np.unique(k, return_inverse=True)
    if len(ids) * (len(keys) + len(cols)) * 8 <= BLOCK_BYTES and len(ids) * len(keys) * len(cols) < 100 * products:
        a, b = np.zeros((len(ids), len(keys))), np.zeros((len(keys), len(cols)))
        a[at, np.repeat(ki, sizes)] = flat
        known = high > low
        b[np.searchsorted(keys, rk[known]), np.searchsorted(cols, c[known])] = x[known]
        dense = a @ b
        whole = lambda i: (np.flatnonzero(dense[:, i]), dense[dense[:, i] != 0, i])
        return cols, ids, whole

    def sparse(i: int) -> Column:
        span = slice(first[i], last[i])
        n = high[span] - low[span]
        record = np.arange(n.sum()) + np.repeat(low[span] - (np.cumsum(n) - n), n)
        m = sizes[record]
        cell = np.arange(m.sum()) + np.repeat(starts[record] - (np.cumsum(m) - m), m)
        sums = np.bincount(at[cell], flat[cell] * np.repeat(np.repeat(x[span], n), m), len(ids))
        found = np.flatnonzero(sums)
        return found, sums[found]

    return cols, ids, sparse


def blocked(left: DataFrame, right: DataFrame, blocks: int, finish: Callable[[np.ndarray, np.ndarray], tuple] | None = None, extra: str = "") -> DataFrame:
    """(col, rows, vals, *extra) of the product of left columns and right cells. ``finish`` gets a column's rows and values and returns
    them as they are to be kept, with the extra values."""
    names = ["col", "rows", "vals", *[x.split()[0] for x in extra.split(",") if x]]

    def one(_, lt: pa.Table, rt: pa.Table) -> pa.Table:
        cols, ids, column = multiplied(lt, rt)
        made = []
        for i, c in enumerate(cols.tolist()):
            at, vals = column(i)
            rows, vals, *more = finish(ids[at], vals) if finish else (ids[at], vals)
            if len(rows):
                made.append((c, rows, vals, *more))
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        held = list(zip(*made)) or [[] for _ in names]
        return pa.table([pa.array(x, kinds[i] if i < 3 else pa.float64()) for i, x in enumerate(held)], names=names)

    r = right.select(F.col("col").cast("long").alias("c"), F.col("row").cast("long").alias("k"), F.col("val").cast("double").alias("x")).withColumn("g", F.pmod(F.xxhash64("c"), F.lit(blocks)))
    need = r.select("g", "k").distinct().join(left.select(F.col("col").cast("long").alias("k"), "rows", "vals"), "k")
    need = need.select((F.col("g") + 0).alias("block"), (F.col("k") + 0).alias("key"), "rows", "vals")  # other names than the right's
    return r.groupBy("g").cogroup(need.groupBy("block")).applyInArrow(lambda key, a, b: one(key, b, a), f"col long, rows array<long>, vals array<double>{', ' + extra if extra else ''}")


def block_count(df: DataFrame, cells: int, products: int) -> int:
    """Blocks so that a block's left columns keep under ``BLOCK_BYTES``: all of the left's cells, or one a product at most."""
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parallel if cells * CELL <= BLOCK_BYTES else max(parallel, -(-products * CELL // BLOCK_BYTES))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The matrix product a b of cells, exact. ``a`` and ``b`` are read several times and should be cheap to read."""
    sizes = a.groupBy("col").agg(F.count("*").alias("n"))
    cells, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    need = b.select("col", F.col("row").alias("k")).join(sizes.select(F.col("col").alias("k"), "n"), "k").groupBy("col").agg(F.sum("n").alias("n"))
    products, most = need.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if min(most, cells) * CELL > BLOCK_BYTES:
        return T.product(a, b)
    return cells_of(blocked(columns_of(a, largest), b, block_count(a, cells, products)))
