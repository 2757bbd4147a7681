"""Quality and language models: held-out accuracy and odd cases."""

import numpy as np

from linkweave.llm import language_id, quality_knn, subwords
from linkweave.llm.queries import QUERIES
from tests.conftest import TINY
from tests.llm.helpers import empty, table

SF = TINY.replace("sf0.001", "sf0.01")


def test_counts_do_not_depend_on_chunks(monkeypatch):
    texts = [b"", b"a", b"hello world " * 40, b"abc" * 500]
    whole = subwords.counts(texts, (2, 3), 10)
    monkeypatch.setattr(subwords, "CHUNK_BYTES", 64)
    assert np.array_equal(whole, subwords.counts(texts, (2, 3), 10))
    assert whole[2].sum() == len(texts[2]) * 2 - 3 and whole[0].sum() == 0


def test_language_held_out(spark):
    got = QUERIES["op5_language_id"](spark, SF)
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.filter("held_out").join(lang, "doc_id").collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows) and np.mean([r["rejected"] for r in rows]) < 0.02


def test_language_odd_cases(spark):
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(table(spark), model).collect()}
    by = {d: (p, s) for d, p, s in got}
    for d in (4, 5, 6, 7):
        assert by[d] == ("und", 0.0)
    assert by[9][0] == "de" and by[1][0] == "en" and by[14][0] in model.languages
    assert language_id.identify(empty(spark), None).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(table(spark), None).collect()} == {"und"}
    kept = language_id.keep_identified(table(spark), model)
    assert kept.columns == table(spark).columns and {1, 9} <= {r["doc_id"] for r in kept.collect()}
    assert language_id.train(empty(spark)) is None


def test_quality_held_out(spark):
    got = QUERIES["op2_quality_knn"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert len(good) > 30 and np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.97


def test_quality_odd_cases(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 0), (9, 0, 0), (8, 1, 0), (77, 1, 1), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    space = quality_knn.train(docs, labels)
    rows = quality_knn.score_quality(docs, space).collect()
    assert len(rows) == 16 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[1] == by[2] and by[4] == by[5]
    assert {r["score"] for r in quality_knn.score_quality(docs, None).collect()} == {0.5}
    assert quality_knn.score_quality(empty(spark), space).count() == 0 and quality_knn.train(docs, labels.limit(0)) is None


def test_votes_match_brute_force():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcde XY#"), 60)) for _ in range(90)]
    space = quality_knn.fit(quality_knn.features(texts[:60]), rng.integers(0, 2, 60))
    v = quality_knn.project(quality_knn.features(texts[60:]), space.centre, space.basis)
    for got, row in zip(quality_knn.vote(texts[60:], space), v):
        c = (space.vectors @ row).astype(float)
        top = np.argsort(-c)[: quality_knn.NEIGHBOURS]
        w = np.maximum(c[top], 0)
        assert abs(got - (w @ space.labels[top]) / w.sum()) < 1e-5


def test_unknown_text_is_rejected(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null and n_chars > 200").select("text", "lang").orderBy("doc_id").collect()
    rng = np.random.default_rng(2)
    some, rest = rows[::2], rows[1::2]
    model = language_id.calibrated([r["text"][: language_id.SAMPLE_CHARS] for r in some], [r["lang"] for r in some])
    kept = [not x for x in language_id.predict([r["text"] for r in rest], model)[2]]
    changed = language_id.predict([language_id.exchanged(r["text"], rng) for r in rest], model)[2]
    assert np.mean(kept) > 0.98 and np.mean(changed) > 0.8
    for left in ("es", "fr"):  # a language that the model never saw, not even as something to reject
        known = [r for r in some if r["lang"] != left]
        model = language_id.calibrated([r["text"][: language_id.SAMPLE_CHARS] for r in known], [r["lang"] for r in known])
        assert np.mean(language_id.predict([r["text"] for r in rest if r["lang"] == left], model)[2]) > 0.6
