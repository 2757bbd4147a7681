"""Quality classifier: similarity-weighted vote of the nearest labelled documents in a latent semantic space.

A text becomes three blocks of shares, under a square root: hashed byte n-grams of its *shapes* (letters folded into
upper and lower, digits into one, everything else as it is) and of its *spellings* (lower-cased bytes), and the shares of
words that do and do not repeat the word before. A truncated singular value
decomposition of a bounded labelled sample gives the latent space. The sample's latent vectors (``LABELLED_DOCS`` rows at
most, so a bounded size) go to all tasks; every document's cosines to all of them are computed exactly, block by block,
and the ``NEIGHBOURS`` most similar vote with their similarity (ties at the last place all vote).

The sample: labelled rows with text outside the held-out fold, by smallest md5(doc_id). Null and empty texts have no
direction; they get the sample's mean label. Without labelled rows all scores are 0.5. Equal texts score alike; a doc_id
labelled twice counts twice; of different texts under one labelled doc_id the smallest is learned. Ids stay out of Python.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from linkweave.llm import subwords
from linkweave.llm.common import fold

LABELLED_DOCS = 4_000
BITS, DIM, NEIGHBOURS = 10, 48, 25
PREDICT_AT = 0.3
BLOCK = 128
#: Of the three blocks: shapes tell more of quality than spellings, which mostly tell the language.
BLOCK_WEIGHTS = (1.0, 0.4, 1.0)

_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass
class Space:
    centre: np.ndarray
    basis: np.ndarray  # features x DIM
    vectors: np.ndarray  # labelled rows x DIM, of length 1 or 0
    labels: np.ndarray


def repeats(text: bytes) -> tuple[int, int]:
    """How many words equal the word before, and how many do not."""
    words = text.split()
    same = sum(map(operator.eq, words, islice(words, 1, None)))
    return same, max(len(words) - 1, 0) - same


def features(texts: list[str | None]) -> np.ndarray:
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    blocks = [
        subwords.counts([t.translate(_SHAPE) for t in raw], (2, 3), BITS), subwords.counts([t.translate(_LOWER) for t in raw], (2,), BITS),
        np.array([repeats(t) for t in raw], np.float32).reshape(-1, 2),
    ]
    return np.concatenate([w * np.sqrt(b / np.maximum(b.sum(axis=1, keepdims=True), 1)) for w, b in zip(BLOCK_WEIGHTS, blocks)], axis=1)


def project(x: np.ndarray, centre: np.ndarray, basis: np.ndarray) -> np.ndarray:
    v = (x - centre) @ basis
    v[x.sum(axis=1) == 0] = 0
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def fit(x: np.ndarray, labels: np.ndarray, seed: int = 5) -> Space:
    """The latent space of the sample: its leading right singular vectors, by randomised subspace iteration."""
    centre = x.mean(axis=0)
    y = x - centre
    dim = min(DIM, *y.shape)
    q = np.linalg.qr(y.T @ (y @ np.random.default_rng(seed).normal(size=(y.shape[1], min(dim + 16, y.shape[1]))).astype(np.float32)))[0]
    for _ in range(3):
        q = np.linalg.qr(y.T @ (y @ q))[0]
    _, _, right = np.linalg.svd(y @ q, full_matrices=False)
    basis = np.ascontiguousarray((q @ right.T)[:, :dim]).astype(np.float32)
    return Space(centre, basis, project(x, centre, basis), labels.astype(np.float64))


def train(documents: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Space | None:
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)).select("doc_id", "quality")
    ids = known.withColumn("m", F.md5(F.col("doc_id").cast("string"))).orderBy("m", "doc_id").limit(LABELLED_DOCS).select("doc_id", "quality")
    ids = ids.groupBy("doc_id", "quality").agg(F.count("*").alias("times"))
    sample = documents.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    sample = sample.groupBy("doc_id", "quality", "times").agg(F.min("text").alias("text")).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))

    def featurize(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            x = features(list(p["text"])).astype(np.float16)
            yield pd.DataFrame({"doc_id": p["doc_id"], "quality": p["quality"], "x": [row.tobytes() for row in x]})

    rows = sample.mapInPandas(featurize, "doc_id long, quality int, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    return fit(np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32), np.array([r["quality"] for r in rows]))


def vote(texts: list[str | None], space: Space | None) -> np.ndarray:
    """Scores of some texts: the labels of the nearest neighbours, weighted by cosine."""
    if space is None:
        return np.full(len(texts), 0.5)
    out = np.empty(len(texts))
    for at in range(0, len(texts), BLOCK):
        v = project(features(texts[at : at + BLOCK]), space.centre, space.basis)
        cosines = (v @ space.vectors.T).astype(np.float64)
        k = min(NEIGHBOURS, cosines.shape[1])
        least = np.partition(cosines, cosines.shape[1] - k, axis=1)[:, [cosines.shape[1] - k]]
        weight = np.where(cosines >= least, np.maximum(cosines, 0), 0)
        total = weight.sum(axis=1)
        out[at : at + len(v)] = np.where(total > 0, (weight @ space.labels) / np.where(total > 0, total, 1), space.labels.mean())
    return np.clip(out, 0, 1)


def score_quality(documents: DataFrame, space: Space | None, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(vote(list(texts), space))

    rows = documents.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), scored("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
