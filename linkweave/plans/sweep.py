"""Parameter grids and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def grid(base: DataFrame, factors: dict[str, list], path_of: list[str]) -> DataFrame:
    """Every base row with every combination of the factors' values; ``path`` joins the named columns by slashes."""
    out = base.withColumn("path", F.concat_ws("/", *path_of))
    for name, values in factors.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out
