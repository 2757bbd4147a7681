"""CIGAR strings and alignment fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lengths(cigar: Column, ops: str = "MIDNSHPX=") -> Column:
    """Lengths of the operations whose letters are given."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), F.lit(1)), lambda x: x.cast("long"))


def total(cigar: Column, ops: str = "MIDNSHPX=") -> Column:
    return F.aggregate(lengths(cigar, ops), F.lit(0).cast("long"), lambda a, x: a + x)


def aligned(cigar: Column) -> Column:
    """Bases in M operations."""
    return total(cigar, "M")


def match_coverage(cigar: Column) -> Column:
    """Share of M among all operation lengths; null for an empty string."""
    return aligned(cigar) / F.nullif(total(cigar), F.lit(0))


def strong(cigar: Column, flag: Column, mapq: Column, min_mapq: float, min_match: int) -> Column:
    """Primary, mapped well, starts with M, has no D, N, P or X, and enough M."""
    primary = flag.bitwiseAND(F.lit(0x900)) == 0
    return primary & (mapq >= min_mapq) & cigar.rlike("^[0-9]+M") & ~cigar.rlike("[DNPX]") & (aligned(cigar) >= min_match)


def percent_identity(match: Column, rep: Column, mismatch: Column, inserts: Column) -> Column:
    return 100 * (1 - (mismatch + inserts) / F.nullif(match + mismatch + rep, F.lit(0)))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def alternates(xa: Column) -> Column:
    """XA tag -> array of (contig, pos, cigar, nm); entries without four fields are dropped."""
    parts = F.filter(F.transform(F.split(xa, ";"), lambda x: F.split(x, ",")), lambda p: F.size(p) == 4)
    return F.transform(parts, lambda p: F.struct(p[0].alias("contig"), p[1].cast("long").alias("pos"), p[2].alias("cigar"), p[3].cast("int").alias("nm")))
