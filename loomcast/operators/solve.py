"""Least squares and penalised means of any width, as Column expressions over arrays.

A design is summed to its normal equations by one aggregation over the entries of its rows that aren't zero; what is left
of a group is one row with a small matrix, on which factors are built by higher-order functions.  A group may have any
number of rows, and the width is bounded by what an array may hold, not by the columns of a generated plan.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.functions.bases import dot, let

#: A diagonal entry counts as zero below this share of the one it started from.
RANK = 1e-9


def gram_entries(rows: DataFrame, by: Sequence[str], x: Column) -> DataFrame:
    """by, _i, _j, _g with _i <= _j: the sums of products of the entries of x, where any isn't zero.

    Rows yield the products of their non-zero entries only (a spline row has four), which are summed before the shuffle.
    """
    some = F.filter(F.transform(x, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"] != 0.0)
    pairs = F.flatten(F.transform(some, lambda a: F.transform(F.filter(some, lambda b: b["i"] >= a["i"]), lambda b: F.struct(a["i"].alias("_i"), b["i"].alias("_j"), (a["v"] * b["v"]).alias("_g")))))
    return rows.select(*by, F.explode(pairs).alias("_e")).select(*by, "_e.*").groupBy(*by, "_i", "_j").agg(F.sum("_g").alias("_g"))


def normal_equations(rows: DataFrame, by: Sequence[str], x: Column, width: int) -> DataFrame:
    """by, a: the Gram matrix of x (`width` entries) by rows, each group's as an array of arrays; missing entries are 0.

    Rows without entries count as zeros; null entries count as zeros too.
    """
    entries = gram_entries(rows, by, F.transform(x, lambda v: F.coalesce(v.cast("double"), F.lit(0.0))))
    packed = F.map_from_entries(F.collect_list(F.struct((F.col("_i") * width + F.col("_j")).alias("at"), "_g")))
    each = entries.groupBy(*by).agg(packed.alias("_m"))  # at most width * width entries

    def entry(i: Column, j: Column) -> Column:
        return F.coalesce(F.try_element_at("_m", F.least(i, j) * width + F.greatest(i, j)), F.lit(0.0))

    index = F.sequence(F.lit(0), F.lit(width - 1))
    return each.select(*by, F.transform(index, lambda i: F.transform(index, lambda j: entry(i, j))).alias("a"))


def matrix(values: np.ndarray) -> Column:
    return F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in values))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: F.zip_with(u, v, lambda s, t: s + t))


def indices(n: Column) -> Column:
    """0 .. n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


EMPTY = "array<double>"


def cholesky(a: Column) -> Column:
    """The lower factor of a positive definite matrix, row j with j + 1 entries."""

    def row(low: Column, j: Column) -> Column:
        def entry(done: Column, k: Column) -> Column:
            mine = lambda l: F.when(k == j, F.sqrt(F.get(F.get(a, j), k) - dot(done, done))).otherwise((F.get(F.get(a, j), k) - dot(done, F.slice(l, F.lit(1), k))) / F.get(l, k))  # noqa: E731, E741
            return F.concat(done, F.array(let(F.get(low, F.when(k < j, k).otherwise(F.lit(0))), mine)))

        return F.concat(low, F.array(F.aggregate(F.sequence(F.lit(0), j), F.array().cast(EMPTY), entry)))

    return F.aggregate(indices(F.size(a)), F.array().cast(f"array<{EMPTY}>"), row)


def solved(low: Column, b: Column) -> Column:
    """x with low low' x = b."""

    def down(y: Column, j: Column) -> Column:
        return F.concat(y, F.array(let(F.get(low, j), lambda r: (F.get(b, j) - dot(y, F.slice(r, F.lit(1), j))) / F.get(r, j))))

    forward = F.aggregate(indices(F.size(low)), F.array().cast(EMPTY), down)

    def up(x: Column, k: Column) -> Column:  # x holds the entries after j, in order
        j = F.size(low) - 1 - k
        column = F.transform(F.slice(low, j + 2, F.greatest(k, F.lit(0))), lambda r: F.get(r, j))
        return F.concat(F.array((F.get(forward, j) - F.when(k > 0, dot(column, x)).otherwise(0.0)) / F.get(F.get(low, j), j)), x)

    return F.aggregate(indices(F.size(low)), F.array().cast(EMPTY), up)


def swept(a: Column, width: int) -> Column:
    """struct(a, rank): a after its first `width` rows and columns are projected out, always the one next that has most left.

    A column with less than RANK of what it had left is a combination of the others and is passed over, so that a matrix
    of any rank gives what least squares (with the smallest norm, or any other solution) leaves.
    """
    index = F.sequence(F.lit(0), F.lit(width - 1))

    def step(state: Column, _: Column) -> Column:
        left = F.transform(index, lambda i: F.struct((F.get(F.get(state["a"], i), i) / F.greatest(F.get(F.get(a, i), i), F.lit(1e-300))).alias("share"), (-i).alias("i")))

        def use(top: Column) -> Column:
            p = -top["i"]

            def eliminate(pivot: Column) -> Column:
                new = F.transform(state["a"], lambda r: let(F.get(r, p) / F.get(pivot, p), lambda f: F.zip_with(r, pivot, lambda u, v: u - f * v)))
                clean = F.transform(new, lambda r, i: F.transform(r, lambda v, j: F.when((i == p) | (j == p), 0.0).otherwise(v)))
                return F.struct(clean.alias("a"), (state["rank"] + 1).alias("rank"))

            return F.when(top["share"] > RANK, let(F.get(state["a"], p), eliminate)).otherwise(state)

        return let(F.array_max(left), use)

    return F.aggregate(index, F.struct(a.alias("a"), F.lit(0).alias("rank")), step)
