"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, word pairs and pairs with one word between, hashed to 2^bits coordinates.
Every coordinate has its own learning rate, and the L1 term keeps most weights at zero, so the model that travels to the
scoring tasks is a short list.  Its size has a bound: 2^bits coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcast.llm.common import short_batches, slices

_EDGES = " .,;:!?\"'()[]{}|*%&$#<>-_/\\«»“”„‘’…"
_KEPT = 25_000


@dataclass(frozen=True)
class Settings:
    """max_train and max_chars bound (in expectation) the labelled rows that a fit takes and the letters of their texts, so
    that the one task that learns holds some 12 bytes for each word of them; the rest are the usual FTRL terms."""

    bits: int = 20
    max_train: int = 16_000
    max_chars: int = 64_000_000
    epochs: int = 5
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.5
    positive: float = 1.5  # how much more a row with label 1 counts


@dataclass(frozen=True)
class Model:
    bits: int
    coordinates: np.ndarray  # sorted, of non-zero weights; the coordinate 2^bits is the intercept
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros((1 << self.bits) + 1)
        w[self.coordinates] = self.weights
        return w


_words: dict[str, int] = {}


def _word(token: str) -> int:
    if len(_words) >= _KEPT:
        _words.clear()
    h = _words[token] = xxhash.xxh3_64_intdigest(token.strip(_EDGES).encode("utf-8", "replace"))
    return h


def features(text: str | None, bits: int) -> np.ndarray:
    """The distinct coordinates of a whole text, ascending; none for null and empty texts."""
    tokens = (text or "").lower().split()
    found = list(map(_words.get, tokens))
    if None in found:
        found = [_word(t) if h is None else h for t, h in zip(tokens, found)]
    h = np.array(found, np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    pairs = h[:-1] * odd + h[1:] if len(h) > 1 else h[:0]
    skips = h[:-2] * odd + (h[2:] ^ np.uint64(0x5851F42D4C957F2D)) if len(h) > 2 else h[:0]
    every = np.concatenate([h, pairs, skips])
    every = (every ^ (every >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((every >> np.uint64(64 - bits)).astype(np.int32))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, s: Settings) -> np.ndarray:
    """Weights (the last is the intercept) after s.epochs passes over rows in the order given."""
    size = 1 << s.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(zi: np.ndarray, ni: np.ndarray, l1: float) -> np.ndarray:
        w = (np.sign(zi) * l1 - zi) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(s.epochs):
        for i, y in zip(rows, labels):
            w, bias = weight(z[i], n[i], s.l1), float(weight(z[size], n[size], 0.0))
            g = 1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, w.sum() + bias)))) - y
            g *= s.positive if y else 1.0
            for at, value in ((i, w), (size, bias)):
                old = n[at]
                n[at] = old + g * g
                z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / s.alpha * value
    return np.append(weight(z[:size], n[:size], s.l1), weight(z[size:], n[size:], 0.0))


def cut_point(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit above which calling rows positive has the best F1; the middle of the gap there, 0 without positives."""
    order = np.argsort(-logits, kind="stable")
    s, y = logits[order], labels[order]
    if not y.any():
        return 0.0
    found = 2.0 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    found[:-1][s[:-1] == s[1:]] = -1.0
    k = int(found.argmax())
    return float((s[k] + s[k + 1]) / 2.0 if k + 1 < len(s) else s[k] - 1.0)


def train(rows: list[np.ndarray], labels: np.ndarray, s: Settings) -> np.ndarray:
    """Weights by ftrl; every fifth row first serves to place the intercept, which rare labels leave too low,
    if these rows hold 20 positive ones or more."""
    held = np.arange(len(rows)) % 5 == 4
    if labels[held].sum() < 20:
        return ftrl(rows, labels, s)
    w = ftrl([r for r, h in zip(rows, held) if not h], labels[~held], s)
    cut = cut_point(np.array([w[r].sum() for r, h in zip(rows, held) if h]) + w[-1], labels[held])
    w = ftrl(rows, labels, s)
    w[-1] -= cut
    return w


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """A model from the rows of labels (key, label) with a key and a label of 0 or 1 and their texts in docs.

    A sample of the labels, chosen by a hash of the key within the bounds of settings, goes to the texts by a broadcast,
    whose size they bound too; the texts aren't shuffled.  They are hashed in parallel; their coordinates then go through
    one task in the order of the hash, as FTRL is sequential.  Without rows the model scores every text about 0.
    """
    bits = settings.bits
    short_batches(docs)
    rows = labels.select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("y").isin(0, 1) & F.col("k").isNotNull())
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def share(part: float) -> DataFrame:
        return rows if part >= 1.0 else rows.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * part))

    part = min(1.0, settings.max_train / max(1, rows.count()))
    chars = texts.join(F.broadcast(share(part)), "k").agg(F.sum(F.length("t"))).first()[0] or 0
    rows = texts.join(F.broadcast(share(part * min(1.0, settings.max_chars / max(1, chars)))), "k").select("h", "t", "y")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            x = pa.array([features(t, bits) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), x, b.column(2)], names=["h", "x", "y"])

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [(h, x, y) for f in frames for h, x, y in zip(f["h"], f["x"], f["y"])]
        if seen:
            seen.sort(key=lambda r: (r[0], r[2], len(r[1])))
            w = train([x for _, x, _ in seen], np.array([y for *_, y in seen]), settings)
            at = np.flatnonzero(w)
            yield pd.DataFrame({"i": at, "w": w[at]})

    model = rows.mapInArrow(hashed, "h long, x array<int>, y int").repartition(1).mapInPandas(learn, "i long, w double").toPandas().sort_values("i")
    if model.empty:
        return Model(bits, np.array([1 << bits]), np.array([-35.0]))
    return Model(bits, model["i"].to_numpy(np.int64), model["w"].to_numpy(float))


def score(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """df with score (0 to 1; higher: likelier toxic) and predicted (1 from 0.5 on); columns so named are replaced
    (names gives others).

    Whole texts are scored, each row by itself.  Null and empty texts get the score of a text without features.
    """
    kept = [c for c in short_batches(df).columns if c not in names]
    weights = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = weights.value
        w = m.dense()
        for texts in batches:
            logits = np.array([w[features(t, m.bits)].sum() for t in texts]) + w[-1]
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(logits, -35.0, 35.0))))

    out = df.select(*kept, scored(text).alias(names[0]))
    return out.withColumn(names[1], (F.col(names[0]) >= 0.5).cast("int"))
