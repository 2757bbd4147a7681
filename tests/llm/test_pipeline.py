"""The pipeline's stages, each on what the one before kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from linkweave.llm import ngram_join
from tests.conftest import TINY


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    secret = "concat(text, ' password = \\'hunter2hunter2\\' end')"  # no document of the table holds a secret
    docs = docs.withColumn("text", F.expr(f"case when doc_id % 5 = 0 then {secret} else text end"))
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(i))
        stage(spark, docs, TINY).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "language_id":
            assert counts[-1] > 0.97 * counts[-2]
        if name == "ngram_join":
            keep = {r["doc_id"] for r in ngram_join.link_components(before).filter("doc_id = component_id").collect()}
            assert {r["doc_id"] for r in docs.collect()} == keep
        if name == "secret_scan":
            assert counts[-1] == counts[-2] and docs.filter("text like '%[secret]%'").count() > 0
    assert docs.columns[:4] == ["doc_id", "start", "length", "ids_crc32"]


def test_run(spark):
    assert corpus_pipeline.run(spark, TINY).filter("length > 2048").count() == 0
