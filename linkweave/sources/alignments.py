"""Alignment, variant and sequence text: lines of one record each, as DataFrames with a column ``line``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The tab-separated columns of the formats, in their order.
SAM = "read flag contig pos mapq cigar next_contig next_pos template_length sequence quality".split()
PSL = (
    "match mismatch rep n_count q_inserts q_insert_bases t_inserts t_insert_bases strand q_name q_size q_start q_end "
    "t_name t_size t_start t_end blocks block_sizes q_starts t_starts"
).split()
LAST = "score t_name t_start t_length t_strand t_size q_name q_start q_length q_strand q_size blocks".split()
BLAST = "query subject identity length mismatch gaps q_start q_end s_start s_end e_value bits".split()
VCF = "chrom pos id ref alt qual filter info".split()
TEXT = set("read contig cigar next_contig sequence quality strand q_name t_name block_sizes q_starts t_starts t_strand q_strand blocks query subject chrom id ref alt filter info qual".split())
DOUBLE = {"identity", "e_value", "bits"}


def columns(df: DataFrame, names: list[str], texts: set[str] = TEXT) -> DataFrame:
    """Tab-separated fields under their names; what is missing or no number is null."""
    f = F.split("line", "\t")
    kind = lambda c, x: x if c in texts else x.try_cast("double" if c in DOUBLE else "long")
    return df.select(*[kind(c, F.get(f, F.lit(i))).alias(c) for i, c in enumerate(names)])


def sam(df: DataFrame) -> DataFrame:
    """Records that are not header lines and not flagged as secondary (256)."""
    return columns(df.filter(~F.col("line").startswith("@") & (F.col("line") != "")), SAM).filter(F.col("flag").bitwiseAND(F.lit(256)) == 0)


def psl(df: DataFrame) -> DataFrame:
    """Data lines: those that begin with a number and a tab."""
    return columns(df.filter(F.col("line").rlike("^[0-9]+\t")), PSL, TEXT - {"blocks"})


def last_tab(df: DataFrame) -> DataFrame:
    """Lines without those of comments (``#``) and blank ones."""
    return columns(df.filter(~F.col("line").startswith("#") & (F.trim("line") != "")), LAST)


def blast_abc(df: DataFrame, mode: str = "bits") -> DataFrame:
    """(a, b, w), a < b: best score of a pair of different sequences; ``mode`` bits, or evalue for -log10, 200 for 0."""
    hits = columns(df.filter(~F.col("line").startswith("#")), BLAST).filter("query <> subject")
    score = F.col("bits") if mode == "bits" else F.when(F.col("e_value") <= 0, 200.0).otherwise(F.least(F.lit(200.0), -F.log10("e_value")))
    pairs = hits.select(F.least("query", "subject").alias("a"), F.greatest("query", "subject").alias("b"), score.alias("w"))
    return pairs.groupBy("a", "b").agg(F.max("w").alias("w"))


def snps(df: DataFrame) -> DataFrame:
    """Variants with one alternative, reference and alternative of one base each."""
    return columns(df.filter(~F.col("line").startswith("#") & (F.col("line") != "")), VCF).filter("ref rlike '^[ACGTacgt]$' and alt rlike '^[ACGTacgt]$'")


def known_alleles(bases: DataFrame) -> DataFrame:
    """Observations (..., base, ref, alt) whose base is the reference or the alternative."""
    return bases.filter("base = ref or base = alt")


def alignment_coverage(start: Column, end: Column, size: Column) -> Column:
    """Share of a query that an alignment spans; null for an empty query."""
    return (end - start) / F.nullif(size, F.lit(0))


def fasta_lengths(records: DataFrame) -> DataFrame:
    """(name, length) of records as Spark reads them with ``lineSep`` ``>`` (column ``value``): the name is the first word of the
    first line, the sequence all that follows without white space."""
    head = F.substring_index("value", "\n", 1)
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    return records.filter(F.trim("value") != "").select(F.split(F.trim(head), "\\s+")[0].alias("name"), F.length(F.regexp_replace(body, "\\s", "")).cast("long").alias("length"))


def community(df: DataFrame) -> DataFrame:
    """``sequence cell abundance`` lines, ``#`` comments left out."""
    f = F.split(F.trim("line"), "\\s+")
    rows = df.filter(~F.col("line").startswith("#")).filter(F.size(f) == 3)
    return rows.select(f[0].alias("sequence"), f[1].alias("cell"), f[2].try_cast("double").alias("abundance"))


def backbone(df: DataFrame, genomes: int, reverse: bool = False) -> DataFrame:
    """(genome, left, right, n_way, extent) of the segments of backbone lines: tab-separated pairs of ends per genome, 0 where it has no part.

    ``n_way`` is how many genomes share the line, ``extent`` how far the ends are apart. Negative ends are reversed parts, which count only with
    ``reverse``. Header and blank lines are left out; another number of fields is an error.
    """
    f = F.split(F.trim("line"), "\t")
    rows = df.filter((F.trim("line") != "") & ~F.col("line").startswith("seq"))
    checked = F.when(F.size(f) == 2 * genomes, f.cast("array<long>")).otherwise(F.raise_error(F.concat(F.lit("fields of the line: "), F.size(f))).cast("array<long>"))
    part = lambda i: F.struct(F.lit(i).cast("long").alias("genome"), F.get("f", F.lit(2 * i)).alias("left"), F.get("f", F.lit(2 * i + 1)).alias("right"))
    there = lambda p: (p["left"] != 0) & (p["right"] != 0) if reverse else (p["left"] > 0) & (p["right"] > 0)
    parts = rows.select(checked.alias("f")).select(F.filter(F.array(*map(part, range(genomes))), there).alias("p"))
    out = parts.select(F.size("p").cast("long").alias("n_way"), F.explode("p").alias("p"))
    return out.select("p.genome", "p.left", "p.right", "n_way", F.abs(F.col("p.right") - F.col("p.left")).alias("extent"))


def coverage_table(df: DataFrame) -> DataFrame:
    """(name, depth, gc) of tab-separated coverage lines: the first word of the first field, the second and the ninth one. ``#ID`` lines and lines
    with fewer fields are left out; what is no number is null."""
    f = F.split(F.trim("line"), "\t")
    rows = df.filter(~F.col("line").startswith("#ID") & (F.size(f) >= 9))
    return rows.select(F.split(f[0], " ")[0].alias("name"), f[1].try_cast("double").alias("depth"), f[8].try_cast("double").alias("gc"))


def normalised_contacts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (u, v, weight) by nodes (node, length, depth): nodes without depth go with their edges, weights are divided
    by the root of both ends' length (a share of the greatest) times depth (a share of the median)."""
    kept = nodes.filter("depth > 0 and length > 0")
    scale = kept.agg(F.max("length").alias("most"), F.percentile("depth", F.lit(0.5)).alias("middle"))  # one row
    size = kept.crossJoin(F.broadcast(scale)).select("node", (F.col("length") / F.col("most") * F.col("depth") / F.col("middle")).alias("size"))
    met = edges.join(size.toDF("u", "su"), "u").join(size.toDF("v", "sv"), "v")
    return met.select("u", "v", (F.col("weight") / F.sqrt(F.col("su") * F.col("sv"))).alias("weight"))
