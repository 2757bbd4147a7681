"""Ids above 2**53 beside a null in the same batch stay exact in every operator on documents."""

import public_tokenizers
import pytest

from linkweave.llm import language_id, media, ngram_join, packing, quality_knn, secret_scan, spotsigs, suffix_dedup
from tests.llm.helpers import A, B

IDS = [None, 2**60 + 1, 2**60 + 3, 2**53 + 1, -(2**61) - 1, 7]
APPLY = {
    "op2": lambda d: quality_knn.score_quality(d, None),
    "op3": secret_scan.scan_secrets,
    "op4": suffix_dedup.dedup_substrings,
    "op5": lambda d: language_id.identify(d, None),
    "op6": lambda d: packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json")),
    "op7": spotsigs.fingerprints,
    "op8": media.media_digests,
    "op9": ngram_join.link_components,
}


def rows(spark):
    texts = [A, "one two three " * 9, A[::-1], B, "short", ""]
    return spark.createDataFrame(list(zip(IDS, texts)), "doc_id long, text string").coalesce(1)


@pytest.mark.parametrize("name", APPLY)
def test_ids_stay_exact(spark, name):
    got = APPLY[name](rows(spark))
    assert dict(got.dtypes)["doc_id"] == "bigint" and {r["doc_id"] for r in got.collect()} == set(IDS)


def test_stages_keep_ids(spark):
    docs = rows(spark).selectExpr("*", "'en' as lang", "'src1' as source", "cast(null as long) as n_chars")
    names = lambda d: {r["doc_id"] for r in d.collect()}
    assert names(ngram_join.one_of_each(docs)) == set(IDS)
    assert names(secret_scan.redact_secrets(docs)) == set(IDS)
    model = language_id.calibrated([A, B] * 20, ["en", "de"] * 20)
    model.threshold = 0.0
    assert names(language_id.keep_identified(docs, model)) == set(IDS[:-1])  # the empty text has no language
