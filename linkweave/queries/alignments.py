"""Alignment blocks: each text is a block, masked letters of its language's genome (N, gaps for white space) over its own letters read backwards.

A block begins at 400 times its document's number; those of even and of odd documents are the two sets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave import model as M
from linkweave.operators import alignment_join as A
from linkweave.registry import query


def text_blocks(spark, sf):
    gapped = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]", "-")
    top, own = F.regexp_replace(gapped, "[^-]", "N"), F.reverse(F.regexp_replace(gapped, "[^A-Za-z-]", "x"))
    count = F.length(F.translate(top, "-", "")).cast("long")
    beg = 400 * F.col("doc_id").cast("long")
    row = lambda name, b, strand, seq: F.struct(name.alias("chr"), b.alias("beg"), (b + count).alias("end"), F.lit(strand).alias("strand"), F.lit(0).cast("long").alias("size"), seq.alias("seq"))
    rows = F.array(row(F.coalesce("lang", F.lit("")), beg, "+", top), row(F.col("doc_id").cast("string"), F.lit(0).cast("long"), "-", own))
    return M.table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("id"), rows.alias("rows"), F.array(top).alias("probs"))


SQL_BLOCKS = """g AS (SELECT CAST(doc_id AS BIGINT) AS id, coalesce(lang, '') AS chr, 400 * CAST(doc_id AS BIGINT) AS beg, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '-', 'g') AS t FROM documents),
 col AS (SELECT id, chr, beg, unnest(string_split(t, '')) AS c, unnest(string_split(reverse(regexp_replace(t, '[^A-Za-z-]', 'x', 'g')), '')) AS o, unnest(range(length(t))) AS j FROM g WHERE t <> ''),
 n AS (SELECT *, beg + coalesce(sum(CAST(c <> '-' AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, sum(CAST(o <> '-' AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM col WINDOW w AS (PARTITION BY id ORDER BY j)),
 seg AS (SELECT id, any_value(chr) AS chr, pos, count(*) - 1 AS gaps, coalesce(string_agg(CASE WHEN c = '-' THEN o END, '' ORDER BY j), '') AS gap, max(CASE WHEN c <> '-' THEN o END) AS let, max(CASE WHEN c <> '-' THEN upto END) AS upto FROM n GROUP BY id, pos HAVING count_if(c <> '-') = 1),
 blk AS (SELECT id, any_value(chr) AS chr, min(pos) AS beg, max(pos) + 1 AS stop FROM seg GROUP BY 1), pr AS (SELECT a.id AS a_id, b.id AS b_id, greatest(a.beg, b.beg) AS low, least(a.stop, b.stop) AS high FROM blk a JOIN blk b ON a.chr = b.chr AND a.id % 2 = 0 AND b.id % 2 <> 0 AND a.beg < b.stop AND b.beg < a.stop),
 m AS (SELECT a_id, b_id, low, high, a.pos, CASE WHEN a.pos = low THEN 0 ELSE greatest(a.gaps, b.gaps) END AS k, CASE WHEN a.pos = low THEN '' ELSE a.gap || repeat('-', greatest(b.gaps - a.gaps, 0)) END AS ag, CASE WHEN a.pos = low THEN '' ELSE b.gap || repeat('-', greatest(a.gaps - b.gaps, 0)) END AS bg,
 CASE WHEN a.pos = low THEN '' ELSE repeat('-', a.gaps) || repeat('~', greatest(b.gaps - a.gaps, 0)) END AS ap, a.let AS al, b.let AS bl, a.upto AS au, b.upto AS bu FROM pr JOIN seg a ON a.id = a_id AND a.pos >= low AND a.pos < high JOIN seg b ON b.id = b_id AND b.pos = a.pos)"""


@query("joined_alignments", f"""WITH {SQL_BLOCKS} SELECT a_id, b_id, any_value(low) AS beg, any_value(high) AS stop, CAST(sum(k + 1) AS BIGINT) AS width, sha256(string_agg(repeat('-', k) || 'N', '' ORDER BY pos)) AS top, sha256(string_agg(ag || al, '' ORDER BY pos)) AS a_seq, sha256(string_agg(bg || bl, '' ORDER BY pos)) AS b_seq,
 sha256(string_agg(ap || 'N', '' ORDER BY pos)) AS a_prob, CAST(max(CASE WHEN pos = low THEN au - CAST(al <> '-' AS BIGINT) END) AS BIGINT) AS a_beg, CAST(max(CASE WHEN pos = high - 1 THEN au END) AS BIGINT) AS a_end, CAST(max(CASE WHEN pos = low THEN bu - CAST(bl <> '-' AS BIGINT) END) AS BIGINT) AS b_beg, CAST(max(CASE WHEN pos = high - 1 THEN bu END) AS BIGINT) AS b_end
 FROM m GROUP BY a_id, b_id""")
def joined_alignments(spark, sf):
    b = text_blocks(spark, sf)
    r, hashed = F.col("rows"), lambda c: F.sha2(c, 256)
    out = A.join_alignments(b.filter("id % 2 = 0"), b.filter("id % 2 <> 0"))
    return out.select("a_id", "b_id", r[0]["beg"].alias("beg"), r[0]["end"].alias("stop"), F.length(r[0]["seq"]).cast("long").alias("width"), hashed(r[0]["seq"]).alias("top"), hashed(r[1]["seq"]).alias("a_seq"), hashed(r[2]["seq"]).alias("b_seq"), hashed(F.col("probs")[0]).alias("a_prob"),
                      r[1]["beg"].alias("a_beg"), r[1]["end"].alias("a_end"), r[2]["beg"].alias("b_beg"), r[2]["end"].alias("b_end"))
