"""Hard negatives by radix selection over integer scores.

Which rows an anchor gets is settled without sorting its scores: cells of the table (a block of anchors against a block of
rows) count the scores of each window by their leading digit, Spark adds the counts, and the bucket that holds the k-th
score is refined by the next digit, until the k-th score itself is known.  Then the cells yield the rows at or above it, no
others.  Scores are worked out again for each digit and never stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcast.llm.common import scratch, stored, whole_key
from loomcast.llm.vectors import blocks, is_finite, rows_held, unpack

BITS = 10  # of a digit
SUB = 64  # anchors whose scores a cell holds at once
ALL = 1 << 62
COUNTS = "anchor long, other long, bin long, c long"
PICKED = "anchor long, other long, id long, score long"


def whole_vectors(rows: pd.Series, width: int, kind: str, scale: float, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and floor(scale * components) of a block, in numbers in which sums up to `most` are exact."""
    ids, labels, m = unpack(rows, width, kind)
    return ids, labels, np.floor(scale * m).astype(np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64)


class Cell:
    """A block of anchors with their windows, against a block of rows."""

    def __init__(self, f: pd.DataFrame, state: pd.DataFrame, width: int, kind: str, scale: float, most: float) -> None:
        left, right = (next(f[f["side"] == k].itertuples()) for k in (0, 1))
        self.anchors, self.own, self.q = whole_vectors(left, width, kind, scale, most)
        self.ids, self.labels, x = whole_vectors(right, width, kind, scale, most)
        self.x = np.ascontiguousarray(x.T)
        self.state = state.assign(at=np.searchsorted(self.anchors, state["anchor"].to_numpy(np.int64))).sort_values("at", kind="stable")

    def windows(self) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        """Each window with the row numbers and scores that lie in it."""
        rows = list(self.state.itertuples())
        at = 0
        while at < len(rows):
            start = rows[at].at
            scores = (self.q[start : start + SUB] @ self.x).astype(np.int64)
            while at < len(rows) and rows[at].at < start + SUB:
                own, known = rows[at].at, {}
                while at < len(rows) and rows[at].at == own:
                    w = rows[at]
                    if w.same not in known:  # the rows that the windows of an anchor choose from
                        fits = (self.labels == self.own[own]) & (self.ids != w.anchor) if w.same else self.labels != self.own[own]
                        j = np.flatnonzero(fits)
                        known[w.same] = j, scores[own - start, j]
                    j, s = known[w.same]
                    lo = max(w.lo, w.base)
                    fits = np.flatnonzero((s >= lo) & (s <= w.hi))
                    yield w, j[fits], s[fits]
                    at += 1


def counted(cell: Cell, step: int) -> pd.DataFrame:
    """anchor, other, bin and c: how many scores of each window have this digit above the window's base.

    Digits below the one that holds the cell's own k-th score can't hold the k-th of all, so they aren't told.
    """
    out = []
    for w, _, s in cell.windows():
        digits = (s - w.base) // step
        digits = digits[digits < 1 << BITS]
        bins, c = np.unique(digits, return_counts=True)
        bins, c = bins[::-1], c[::-1]
        keep = np.cumsum(c) - c < w.need
        out += [(w.anchor, w.other, b, n) for b, n in zip(bins[keep].tolist(), c[keep].tolist())]
    return pd.DataFrame(out, columns=["anchor", "other", "bin", "c"])


def picked(cell: Cell) -> pd.DataFrame:
    """anchor, other, id and score of the rows above the k-th score of each window, and of those that have it, the
    smallest ids, as many as are needed."""
    out = []
    for w, j, s in cell.windows():
        ids = cell.ids[j]
        if not w.whole and (s == w.base).sum() > w.need:
            tied = np.flatnonzero(s == w.base)
            tied = tied[np.argpartition(ids[tied], w.need - 1)[: w.need]]
            keep = np.r_[np.flatnonzero(s > w.base), tied]
            ids, s = ids[keep], s[keep]
        out += [(w.anchor, w.other, i, x) for i, x in zip(ids.tolist(), s.tolist())]
    return pd.DataFrame(out, columns=["anchor", "other", "id", "score"])


class Cells:
    """All cells of two tables of blocks, to be met with the windows of their anchors."""

    def __init__(self, anchors: DataFrame, rows: DataFrame, counts: tuple[int, int], width: int, kind: str, scale: float, most: float) -> None:
        self.many, self.plan = counts[1], (width, kind, scale, most)
        self.blocks = counts[0]
        left = anchors.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(counts[1] - 1)))).select(F.col("block").alias("a"), "r", F.lit(0).alias("side"), "ids", "extra", "m")
        right = rows.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(counts[0] - 1)))).select("a", F.col("block").alias("r"), F.lit(1).alias("side"), "ids", "extra", "m")
        self.frame = left.union(right)

    def met(self, state: DataFrame, step: int | None) -> DataFrame:
        """The counts of a digit, or with no step the rows that qualify."""
        plan = self.plan

        def run(f: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
            if len(f) < 2 or windows.empty:
                return pd.DataFrame(columns=[c.split()[0] for c in (PICKED if step is None else COUNTS).split(", ")]).astype(np.int64)
            cell = Cell(f, windows, *plan)
            return picked(cell) if step is None else counted(cell, step)

        asked = state.withColumn("a", F.pmod(F.xxhash64("anchor"), F.lit(self.blocks)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(self.many - 1))))
        return self.frame.groupBy("a", "r").cogroup(asked.groupBy("a", "r")).applyInPandas(run, PICKED if step is None else COUNTS)


def select(cells: Cells, windows: DataFrame, k: int, bits: int, put) -> DataFrame:
    """anchor, other, id, score, rank of the k best rows of each window (anchor, other, same, lo, hi)."""
    levels = math.ceil(bits / BITS)
    state = put(windows.select("anchor", "other", "same", "lo", "hi", F.lit(-(1 << (bits - 1))).cast("long").alias("base"), F.lit(k).cast("long").alias("need"), F.lit(False).alias("whole")))
    for level in range(levels):
        step = 1 << (BITS * (levels - 1 - level))
        counts = cells.met(state.where("NOT whole"), step).groupBy("anchor", "other", "bin").agg(F.sum("c").alias("c"))
        down = Window.partitionBy("anchor", "other").orderBy(F.desc("bin"))  # at most 2^BITS rows
        upto = counts.withColumn("upto", F.sum("c").over(down)).join(state.select("anchor", "other", "need"), ["anchor", "other"])
        kth = upto.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("c") < F.col("need"))).select("anchor", "other", "bin", (F.col("need") - F.col("upto") + F.col("c")).alias("left"))
        found = state.join(kth, ["anchor", "other"], "left")
        state = put(found.select(
            "anchor", "other", "same", "lo", "hi",
            F.when(F.col("bin").isNull(), F.col("base")).otherwise(F.col("base") + F.col("bin") * F.lit(step)).alias("base"),
            F.coalesce("left", "need").alias("need"), (F.col("whole") | F.col("bin").isNull()).alias("whole"),
        ))
    ranked = put(cells.met(state, None)).withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "other").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def mine(
    df: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
    positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90), sizes: tuple[int, int] = (16384, 16384),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product.  An anchor's positives are its best other
    rows of its label, and each of them opens a window: rows of other labels with a score between the two percentages of
    the positive's, of which the best are returned.  Ties go to the smaller key.  Fewer rows are returned where there are
    fewer.  Rows with a null key or label, a null vector, or null or non-finite components take no part; shorter vectors
    are filled with zeros.  Of rows that share a key the one with the smallest label, then the smallest vector, stands for
    it.  Empty tables give an empty one.  Scores are exact up to 2^61; vectors that may pass it stop the query.

    sizes: anchors and rows of a cell, at most.
    """
    kind = "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"  # as exact as they come
    rows = df.select(whole_key(df, key).alias("id"), label.cast("long").alias("extra"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("extra").isNotNull() & is_finite(F.col("v")))
    one = rows.groupBy("id").agg(F.min(F.struct("extra", "v", "asks")).alias("r")).select("id", "r.*")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    with scratch(df.sparkSession) as put:
        one = put(one)
        shape = one.agg(F.max(F.size("v")).alias("width"), F.max(length).alias("most"), F.count("*").alias("n")).first()
        width, most = shape["width"] or 1, (shape["most"] or 0.0) * (1 + 1e-9) + 1  # no score, nor a partial sum, is larger
        if most >= 1 << 61:
            raise ValueError("scores of these vectors may not fit in a long")
        bits = math.ceil(math.log2(2 * most + 2)) + 1
        held = max(512, min(sizes[1], math.ceil(shape["n"] / 16)))
        right, many = blocks(one.select("id", "extra", "v"), width, rows_held(held, width), kind)
        left, few = blocks(one.where("asks").select("id", "extra", "v"), width, rows_held(sizes[0], width), kind)
        cells = Cells(put(left), put(right), (few, many), width, kind, scale, most)
        open_ = one.where("asks").select(F.col("id").alias("anchor"), F.col("id").alias("other"), F.lit(True).alias("same"), F.lit(-ALL).alias("lo"), F.lit(ALL).alias("hi"))
        near = put(select(cells, open_, positives, bits, put)).select("anchor", F.col("id").alias("other"), F.col("score").alias("positive"))
        rest = F.pmod(F.col("positive"), F.lit(100))  # whole numbers, as doubles aren't exact; in parts, as products may not fit
        hundreds = F.expr("(positive - pmod(positive, 100L)) div 100L")
        low, high = (hundreds * p + F.floor((rest * p + up) / 100) for p, up in zip(percent, (99, 0)))
        windows = near.select("anchor", "other", F.lit(False).alias("same"), low.alias("lo"), high.alias("hi")).where("lo <= hi")
        best = select(cells, windows, negatives, bits, put).withColumnRenamed("score", "negative")
        out = best.join(near, ["anchor", "other"])
        return stored(out.select(F.col("anchor").alias("anchor_id"), F.col("other").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("positive").alias("positive_score"), F.col("negative").alias("negative_score")))


ORACLE = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10"""
