"""Linkages as a stream: edge weights kept up to date by appended placements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def edge_stream(pairs: DataFrame, delay: str, width: str) -> DataFrame:
    """(window, u, v, weight) of a stream of contig pairs (ts, contig1, contig2): counts per unordered pair and window.

    Pairs later than ``delay`` behind the newest are dropped, so the state is bounded by windows still open.
    """
    ends = pairs.filter("contig1 <> contig2").select("ts", F.least("contig1", "contig2").alias("u"), F.greatest("contig1", "contig2").alias("v"))
    return ends.withWatermark("ts", delay).groupBy(F.window("ts", width), "u", "v").agg(F.count("*").alias("weight"))


def read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of parquet files of (ts, contig1, contig2)."""
    return spark.readStream.schema("ts timestamp, contig1 long, contig2 long").parquet(folder)
