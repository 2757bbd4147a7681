"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text's vector is the mean of the embeddings of its hashed 2- to 4-byte subwords (lower-cased letters, word ends
marked by a space); a linear softmax over the learned languages follows. Embeddings and weights are trained together by
stochastic gradient descent on a bounded sample of labelled rows: at most ``TRAIN_DOCS`` rows with text and lang, dealt
round robin over the languages by md5(doc_id); of a doc_id that repeats, one row.

Rejection is calibrated on text that the model was not fitted to. A fifth of the sample is held out. What should be
rejected is made of it: the texts with the letters of each word shuffled, with letters exchanged throughout, and for each of at most
``LEFT_OUT`` languages its texts under a model that was fitted without it. What should be kept is made of the texts and of halves of two of them, as a text may hold passages of another known language.
A logistic regression on the lead of the best logit over the second and over the last, the
length of the text and their products tells known from unknown text. The threshold lies halfway between
the scores of both where they part, and else where ``KEPT`` of what should be kept stays.

The prediction is a learned language, or ``und`` (score 0) where the text is null or has no letter, or where nothing could
be learned. The score is the chance, so calibrated, that the text is of a known language, times the softmax share. ``rejected`` marks ``und``
and text under the threshold. Equal texts are predicted alike; extra columns and repeated rows do no harm.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from linkweave.llm import subwords
from linkweave.llm.common import fold

TRAIN_DOCS = 2_000
BITS, SIZES, DIM = 12, (2, 3, 4), 16
EPOCHS, BATCH, RATE = 30, 16, 8.0
LEFT_OUT, LEFT_OUT_EPOCHS, KEPT = 8, 10, 0.998
TEMPERATURES = tuple(2.0**i for i in range(-4, 5))
#: Characters of each sampled row that the model is fitted to (the sample is all that comes to the driver).
SAMPLE_CHARS = 4_000
#: Characters of each held-out text that are changed to make unknown text.
MADE_CHARS = 2_000
#: Rows whose subword counts a task holds at once.
ROWS = 256
LETTER = re.compile(r"[^\W\d_]")

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_DROP = bytes(c for c in range(33, 127) if not chr(c).isalpha())


@dataclass
class Model:
    """``weights``: (subword x language) logits of one occurrence, the product of embeddings and softmax weights."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    known: np.ndarray | None = None  # weights of the regression; None: all text counts as known
    threshold: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights + self.bias).astype(np.float64)


def averages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each hashed subword among a text's subwords, and how many it has."""
    raw = [b" " + (t or "").encode("utf-8", "replace").translate(_LOWER, _DROP) + b" " for t in texts]
    seen = subwords.counts(raw, SIZES, BITS, within_words=True)
    total = seen.sum(axis=1, keepdims=True)
    return seen / np.maximum(total, 1), total.ravel()


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], epochs: int, seed: int) -> Model:
    """Embeddings and softmax weights by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    used = rng.permutation(len(y))
    emb = rng.normal(0, 0.1, (x.shape[1], DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(used), BATCH):
            rows = used[at : at + BATCH]
            xb = x[rows]
            mid = xb @ emb
            slope = softmax(mid @ out + bias)
            slope[np.arange(len(rows)), y[rows]] -= 1
            slope /= len(rows)
            back = slope @ out.T
            out -= rate / 8 * (mid.T @ slope)
            bias -= rate / 80 * slope.sum(axis=0)
            emb -= rate * x.shape[1] / 256 * (xb.T @ back)
        used = rng.permutation(used)
    return Model(names, emb @ out, bias)


def evidence(logits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the regression sees of some texts."""
    top = np.sort(logits, axis=1)[:, ::-1]
    lead, spread, long = (top[:, 0] - top[:, 1]) / 10, (top[:, 0] - top[:, -1]) / 10, np.log2(1 + size) / 10
    return np.stack([np.ones(len(lead)), lead, spread, long, lead * long, spread * long], axis=1)


def logistic(e: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression by Newton's steps; both classes weigh alike."""
    w, weight = np.zeros(e.shape[1]), np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1)) * len(good)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(e @ w, -30, 30)))
        slope = e.T @ (weight * (p - good)) + 1e-2 * w
        w -= np.linalg.solve((e * (weight * p * (1 - p))[:, None]).T @ e + 1e-2 * np.eye(len(w)), slope)
    return w


def chance(e: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    return np.ones(len(e)) if w is None else 1 / (1 + np.exp(-np.clip(e @ w, -30, 30)))


def shuffled(text: str, rng: np.random.Generator) -> str:
    """A text with the letters of each word in another order."""
    return " ".join("".join(rng.permutation(list(w))) for w in text.split(" "))


def exchanged(text: str, rng: np.random.Generator) -> str:
    """A text with letters exchanged throughout."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return text.lower().translate(str.maketrans(letters, "".join(rng.permutation(list(letters)))))


def calibrated(texts: list[str], languages: list[str], seed: int = 11) -> Model:
    """The model of a labelled sample, with temperature, regression and threshold from text that it was not fitted to."""
    names = sorted(set(languages))
    y = np.array([names.index(v) for v in languages])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    x, size = averages(texts)
    model = fit(x[used], y[used], names, EPOCHS, seed)
    if len(names) < 2 or not len(held):
        return model
    z = model.logits(x[held])
    losses = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in TEMPERATURES}
    model.temperature = min(losses, key=lambda t: (losses[t], abs(np.log(t))))
    right = z.argmax(axis=1) == y[held]
    pairs = [f"{texts[i][: len(texts[i]) // 2]} {texts[j][len(texts[j]) // 2 :]}" for i, j in zip(held, rng.permutation(held))]
    both, n = averages(pairs)
    good = np.concatenate([evidence(z, size[held])[right], evidence(model.logits(both), n)])
    bad = []
    for change in (shuffled, exchanged):
        other, n = averages([change(texts[i][:MADE_CHARS], rng) for i in held])
        bad.append(evidence(model.logits(other), n))
    for k in range(min(len(names), LEFT_OUT) if len(names) > 2 else 0):
        rest, own = used[y[used] != k], held[y[held] == k]
        without = fit(x[rest], y[rest] - (y[rest] > k), names[:k] + names[k + 1 :], LEFT_OUT_EPOCHS, seed)
        bad.append(evidence(without.logits(x[own]), size[own]))
    bad = np.concatenate(bad)
    model.known = logistic(np.concatenate([good, bad]), np.arange(len(good) + len(bad)) < len(good))
    high, low = np.sort(chance(good, model.known)), np.sort(chance(bad, model.known))
    if len(high):
        kept, most = high[int((1 - KEPT) * len(high))], low[int(KEPT * (len(low) - 1))] if len(low) else 0.0
        model.threshold = float((kept + most) / 2 if most < kept else kept)
    return model


def train(documents: DataFrame, folds: int = 4, held_out: int = 2) -> Model | None:
    """Fits on documents outside the held-out fold; None where no row has text and lang."""
    known = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    # of a language with many documents only those of small md5 are numbered, twice as many as are taken, so that no task gets all
    ids = known.select("doc_id", "lang", F.md5(F.col("doc_id").cast("string")).alias("m")).distinct()
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"))
    small = F.conv(F.substring("m", 1, 8), 16, 10).cast("double") * F.col("n") <= 2.0**32 * 2 * TRAIN_DOCS
    ids = ids.join(counts, "lang").filter(small).withColumn("turn", F.row_number().over(W.partitionBy("lang").orderBy("m", "doc_id")))
    ids = ids.orderBy("turn", "lang").limit(TRAIN_DOCS).select("doc_id", "lang")
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = sorted(sample.select(F.md5(F.col("doc_id").cast("string")).alias("m"), "doc_id", "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect())
    return calibrated([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and rejections of some texts."""
    lettered = np.array([bool(t) and LETTER.search(t) is not None for t in texts], bool)
    if model is None or not len(texts):
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    x, size = averages(texts)
    z = model.logits(x)
    known = chance(evidence(z, size), model.known) if z.shape[1] > 1 else np.ones(len(z))
    score = np.where(lettered, softmax(z / model.temperature).max(axis=1) * known, 0.0)
    names = [model.languages[b] if ok else "und" for b, ok in zip(z.argmax(axis=1), lettered)]
    return names, score, ~lettered | (known < model.threshold)


def judged(model: Model | None):
    """A column function: lang_pred, score and rejected of each text. Ids and other columns stay out of Python."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        parts = [predict(list(texts.iloc[at : at + ROWS]), model) for at in range(0, len(texts), ROWS)]
        return pd.DataFrame({"lang_pred": [n for p in parts for n in p[0]], "score": np.concatenate([p[1] for p in parts]), "rejected": np.concatenate([p[2] for p in parts])})

    return of


def identify(documents: DataFrame, model: Model | None, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected."""
    rows = documents.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), judged(model)("text").alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected")


def keep_identified(documents: DataFrame, model: Model | None) -> DataFrame:
    """The documents whose language is not rejected, as they came."""
    return documents.filter(~judged(model)("text")["rejected"])
