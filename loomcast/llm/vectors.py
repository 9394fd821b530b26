"""Near-duplicate vectors by PCA-ordered tiles, and exact top-k search by no-random-access aggregation.

Both compare blocks of rows: a block is one record that holds its vectors as bytes, every pair of blocks meets in one
task, and no pair of rows is ever a record.  Work grows with the pairs of rows, as the questions ask; memory doesn't.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcast.llm.common import components, forest, join_hot, scratch, stored, whole_key

SUB = 1024
TURNED = 512  # leading components that are turned to principal axes; bounds the moments that a task holds
HELD = 1 << 22  # components in a block of rows, at most


def is_finite(x: Column) -> Column:
    """Whether an array column is neither null nor holds null or non-finite components."""
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return x.isNotNull() & F.coalesce(fine, F.lit(False))


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; those that are shorter are filled with zeros."""
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def rows_held(rows: int, width: int) -> int:
    """How many rows of a width a block may have."""
    return max(1, min(rows, HELD // max(1, width)))


def blocks(df: DataFrame, width: int, size: int, kind: str) -> tuple[DataFrame, int]:
    """(block int, ids, extra, m as bytes) of about `size` rows of df (id, extra, v) each, dealt by a hash of the id; and
    their number.  Components are held as numbers of the numpy type `kind`."""
    n = max(1, math.ceil(df.count() / size))
    dealt = df.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), "id", "extra", "v")

    def pack(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable")
        return pd.DataFrame({"block": [key[0]], "ids": [f["id"].to_numpy(np.int64).tobytes()], "extra": [f["extra"].to_numpy(np.int64).tobytes()], "m": [matrix(f["v"], width).astype(kind).tobytes()]})

    return dealt.groupBy("block").applyInPandas(pack, "block int, ids binary, extra binary, m binary"), n


def unpack(row: object, width: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    return ids, np.frombuffer(row.extra, np.int64), np.frombuffer(row.m, kind).reshape(len(ids), width).astype(float)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; each is first divided by its largest component, as squares may leave the range of doubles."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def principal_axes(df: DataFrame, width: int) -> np.ndarray:
    """Orthonormal axes of the leading components (TURNED at most) by falling variance, from the second moments of all
    unit vectors, which Spark sums."""
    lead = min(width, TURNED)
    names = [f"c{j}" for j in range(lead)]

    def moments(frames):
        total = np.zeros((lead, lead))
        for f in frames:
            step = rows_held(len(f), width)
            for at in range(0, len(f), step):
                m = unit(matrix(f["v"].iloc[at : at + step], width))[:, :lead]
                total += m.T @ m
        out = pd.DataFrame(total, columns=names)
        out.insert(0, "i", range(lead))
        yield out

    sums = df.select("v").mapInPandas(moments, "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).toPandas()
    if sums.empty:
        return np.eye(lead)
    values, axes = np.linalg.eigh(sums.sort_values("i")[names].to_numpy())
    return axes[:, np.argsort(-values, kind="stable")]


def turned(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit rows in principal coordinates; components beyond the axes stay as they are, so products stay what they are."""
    return np.hstack([u[:, : len(axes)] @ axes, u[:, len(axes) :]])


def linked(u: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray, steps: list[int], least: float) -> np.ndarray:
    """Which unit rows of u and v, whose principal coordinates are a and b, have a product >= least.

    The leading coordinates are multiplied first; what the others can add is at most the product of the suffix norms,
    which rides along as one more coordinate.  Pairs that can't reach the threshold stop there; the others go on.  Those
    left at the end are settled by the product of u and v in double precision, whatever the width.
    """
    lead = steps[0]

    def headed(m: np.ndarray, k: int) -> np.ndarray:
        return np.hstack([m[:, :k], np.linalg.norm(m[:, k:], axis=1, keepdims=True)]).astype(np.float32)

    open_ = headed(a, lead) @ headed(b, lead).T >= least - 1e-5  # single precision, so with a margin
    count = int(open_.sum())
    if count * 16 > open_.size:  # a group of near copies: one dense product costs less than single pairs
        return u @ v.T >= least
    i, j = np.nonzero(open_)
    partial, at = np.einsum("ij,ij->i", a[i, :lead], b[j, :lead]), lead
    for to in steps[1:]:
        partial = partial + np.einsum("ij,ij->i", a[i, at:to], b[j, at:to])
        rest = np.linalg.norm(a[:, to:], axis=1)[i] * np.linalg.norm(b[:, to:], axis=1)[j]
        go = partial + rest >= least - 1e-9
        i, j, partial, at = i[go], j[go], partial[go], to
    sure = np.einsum("ij,ij->i", u[i], v[j]) >= least
    out = np.zeros(open_.shape, bool)
    out[i[sure], j[sure]] = True
    return out


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, block: int = 16384, steps: tuple[int, ...] = (16, 32)) -> DataFrame:
    """key, n_links, component_id and kept for each row of df.

    n_links counts the other rows with a cosine >= least; component_id is the smallest key reachable by links; kept marks
    the rows that keep it.  Null vectors, zero vectors and those with null or non-finite components link with nothing.
    Equal vectors are one class, whose members link with each other.  Rows with a null key are left out, an empty table
    gives an empty one; of rows that share a key each counts as a row.  Vectors of unequal length are filled with zeros.
    block bounds the rows of a block; steps are the coordinates after which pairs may stop.
    """
    every = df.select(whole_key(df, key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL")
    some = is_finite(F.col("v")) & F.coalesce(F.exists("v", lambda c: c != 0.0), F.lit(False))
    rows = every.where(some)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    kind = "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"  # as exact as they come
    classes = stored(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("extra")))
    axes = principal_axes(classes, width)
    packed, many = blocks(classes, width, rows_held(min(block, max(512, math.ceil(classes.count() / 16))), width), kind)
    stops = sorted({min(width, s) for s in steps} | {width})

    def compare(pair: tuple, f: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for row in f.sort_values("block").itertuples():
            ids, members, m = unpack(row, width, kind)
            u = unit(m)
            sides.append((ids, members, u, turned(u, axes)))
        (ia, ca, ua, a), (ib, cb, ub, b) = sides[0], sides[-1]
        same = len(sides) == 1
        la, lb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
        src, dst = [], []
        for p in range(0, len(ia), SUB):
            for q in range(p if same else 0, len(ib), SUB):
                left, right = slice(p, p + SUB), slice(q, q + SUB)
                link = linked(ua[left], ub[right], a[left], b[right], stops, least)
                if same and p == q:
                    link = np.triu(link, 1)
                if link.any():
                    la[left] += link @ cb[right]
                    lb[right] += ca[left] @ link
                    i, j = forest(link)
                    src.append(ia[p + i])
                    dst.append(ib[q + j])
        sums = [(x[k], s[k]) for x, s in ((ia, la), (ib, lb)) for k in [np.flatnonzero(s)]]
        src, dst = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (src, dst))
        ids = np.concatenate([*(x for x, _ in sums), src])
        links = np.concatenate([*(s for _, s in sums), np.zeros(len(src), np.int64)])
        to = np.concatenate([np.full(len(ids) - len(src), -1, np.int64), dst])
        return pd.DataFrame({"id": ids, "links": links, "other": to, "edge": np.arange(len(ids)) >= len(ids) - len(src)})

    with scratch(df.sparkSession) as put:
        pairs = put(packed).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
        pairs = pairs.select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "ids", "extra", "m")
        found = put(pairs.groupBy("lo", "hi").applyInPandas(compare, "id long, links long, other long, edge boolean"))
        sums = stored(found.where("NOT edge").groupBy("id").agg(F.sum("links").alias("links")))
        # A class is named by its smallest id, so the smallest class of a component is its smallest row.
        roots = components(found.where("edge").select(F.col("id").alias("src"), F.col("other").alias("dst"))).withColumnRenamed("node", "id")
    per_class = classes.join(sums, "id", "left").join(roots, "id", "left").select("v", F.col("extra").alias("members"), (F.coalesce("links", F.lit(0)) + F.col("extra") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    linked_rows = join_hot(rows, stored(per_class), ["v"], "members").select("id", "n_links", "component_id")
    alone = every.where(~some).select("id", F.lit(0).cast("long"), F.col("id"))
    return linked_rows.union(alone).select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


DEPTHS = (0.5, 0.75, 0.875, 0.9375, 0.96875, 1.0)  # shares of each list that have been read when bounds are looked at
DENSE = 0.05  # share of open rows above which bounds are made for all rows of a block at once


class Lists:
    """A block of rows as one sorted list for each dimension, which queries read from the end that favours them.

    A query with a positive weight reads a list from the top, one with a negative weight from the bottom; weights of 0 read
    nothing.  A row has been seen in a list if its value lies in the part read.  What it adds there is then known; else it
    is at most the last value read times the weight (upper bound), and at least the list's other end (lower bound).
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.sorted = x, np.sort(x, axis=0)
        self.resolved = 0  # rows whose final score was worked out, over all queries

    def _ends(self, depth: float) -> tuple[np.ndarray, np.ndarray]:
        """The last values read from the top and from the bottom of each list."""
        n = len(self.x)
        read = min(n, max(1, math.ceil(n * depth)))
        return self.sorted[n - read], self.sorted[read - 1]

    def upper(self, q: np.ndarray, depth: float) -> np.ndarray:
        """Upper bounds of all rows (columns) for queries (rows)."""
        top, bottom = self._ends(depth)
        return np.maximum(q, 0) @ np.maximum(self.x, top).T + np.minimum(q, 0) @ np.minimum(self.x, bottom).T

    def lower(self, q: np.ndarray, depth: float) -> np.ndarray:
        top, bottom = self._ends(depth)
        worst, best = self.sorted[0], self.sorted[-1]
        return np.maximum(q, 0) @ np.where(self.x >= top, self.x, worst).T + np.minimum(q, 0) @ np.where(self.x <= bottom, self.x, best).T

    def upper_of(self, q: np.ndarray, i: np.ndarray, j: np.ndarray, depth: float) -> np.ndarray:
        """Upper bounds of single pairs: query i, row j."""
        top, bottom = self._ends(depth)
        w, x = q[i], self.x[j]
        return np.where(w > 0, w * np.maximum(x, top), w * np.minimum(x, bottom)).sum(1)

    def search(self, q: np.ndarray, k: int, floor: np.ndarray, depths: tuple[float, ...] = DEPTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, row and score of all pairs that may be among the k best of a query, given floors that scores must reach.

        Lists are read deeper in steps.  After each, rows with an upper bound below the floor are out for good; a query
        without a floor takes its k-th best lower bound for one.  Reading stops once no query has more than 2 k rows
        left.  Only then are the scores of those rows worked out.  At depth 1 all is read, and the bounds are the scores.
        """
        n = len(self.x)
        floor, blind = floor.copy(), np.flatnonzero(floor == -np.inf) if n > k else []
        open_, i, j = np.ones((len(q), n), bool), None, None
        for depth in depths:
            if i is None:
                if len(blind) and depth > 0.7:  # before, lower bounds say next to nothing
                    floor[blind] = np.maximum(floor[blind], np.partition(self.lower(q[blind], depth), n - k, axis=1)[:, n - k])
                open_ &= self.upper(q, depth) >= floor[:, None]
                if open_.mean() <= DENSE:
                    i, j = np.nonzero(open_)
            else:
                go = self.upper_of(q, i, j, depth) >= floor[i]
                i, j = i[go], j[go]
            if i is not None and (not len(i) or np.bincount(i).max() <= 2 * k):
                break
        if i is None:
            i, j = np.nonzero(open_)
        self.resolved += len(i)
        score = np.empty(len(i))
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            score[part] = np.einsum("ij,ij->i", q[i[part]], self.x[j[part]])
        return i, j, score


def best_of(i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates (query number, score, id) the k best of each query, by query; ties go to the smaller id."""
    order = np.lexsort((ids, -score, i))
    i, score, ids = i[order], score[order], ids[order]
    start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
    rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
    return i[rank < k], score[rank < k], ids[rank < k]


def top_k(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, sizes: tuple[int, int, int] = (512, 2048, 8)) -> DataFrame:
    """query_id, rank, vec_id and score: for each row where is_query holds, its k best other rows.

    Components become floor(scale * x); the score is their integer inner product.  Ties go to the smaller key.  Vectors
    that are null or hold null or non-finite components take no part; shorter vectors are filled with zeros; of rows
    that share a key none is a candidate for the other.  Scores below 2^53 are exact; keys are any long.

    A block of queries meets every block of candidates, which is its sorted lists.  A task reads several blocks one after
    the other, and what it has found is the floor for the next.  sizes: queries in a block, candidates in a block, blocks
    of candidates in a task.
    """
    kind = "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"  # as exact as they come

    def usable(rows: DataFrame) -> DataFrame:
        rows = rows.select(whole_key(df, key).alias("id"), F.lit(1).cast("long").alias("extra"), F.col(vector).cast("array<double>").alias("v"))
        return rows.where(F.col("id").isNotNull() & is_finite(F.col("v")))

    rows, ask = usable(df), usable(df.where(is_query))
    shape = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    width = shape["width"] or 1
    single = (scale * (shape["most"] or 0.0) + 1) ** 2 * width < 2**23
    queries, nq = blocks(ask, width, rows_held(sizes[0], width), kind)
    others, nc = blocks(rows, width, rows_held(sizes[1], width), kind)
    groups = max(1, math.ceil(nc / sizes[2]))
    left = stored(queries).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(F.col("block").alias("q"), "g", F.lit(-1).alias("block"), "ids", "extra", "m")
    right = stored(others).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).select("q", F.floor(F.col("block") / sizes[2]).cast("int").alias("g"), "block", "ids", "extra", "m")

    def search(_: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block")
        first = next(f.itertuples())
        if first.block != -1:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(np.int64)
        whole = lambda m: np.floor(scale * m).astype(np.float32 if single else np.float64)
        qid, _, q = unpack(first, width, kind)
        q, floor = whole(q), np.full(len(qid), -np.inf)
        best = tuple(np.empty(0, np.int64) for _ in range(3))
        for row in f.iloc[1:].itertuples():
            ids, _, x = unpack(row, width, kind)
            i, j, score = Lists(whole(x)).search(q, k + 1, floor)  # one more, as the query itself may be among them
            other = ids[j] != qid[i]
            best = best_of(*(np.concatenate(x) for x in zip(best, (i[other], score[other].astype(np.int64), ids[j[other]]))), k)
            if len(best[0]):
                worst = np.flatnonzero(np.r_[best[0][1:] != best[0][:-1], True])  # the last row of each query
                full = worst[np.diff(np.r_[-1, worst]) == k]
                floor[best[0][full]] = best[1][full]
        return pd.DataFrame({"query_id": qid[best[0]], "vec_id": best[2], "score": best[1]})

    found = left.union(right).groupBy("q", "g").applyInPandas(search, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
