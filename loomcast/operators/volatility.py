"""The mixture step of stochastic volatility for a given level, as Column expressions and a scan.

The log of a squared residual is the log variance plus noise that a mixture of ten normals approximates.  Given a level,
each row has a probability for each component; their moments make an observation of the log variance, whose smoothed path
is that of an AR(1) around mu.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.functions.bases import dot, doubles, let
from loomcast.operators import scan
from loomcast.operators.gibbs import MIX_M, MIX_P, MIX_V
from loomcast.operators.ranges import PART

OFFSET = 1e-10  # keeps the log of a residual of 0 finite


def log_square(residual: Column) -> Column:
    return F.log(residual * residual + F.lit(OFFSET))


def mixture_weights(u: Column, level: Column) -> Column:
    """An array of the probabilities of the components, given log squares u and log variances."""
    def one(p: float, m: float, v: float) -> Column:
        gap = u - level - F.lit(m)
        return F.lit(math.log(p) - 0.5 * math.log(v)) - gap * gap * F.lit(0.5 / v)

    logs = F.array(*(one(p, m, v) for p, m, v in zip(MIX_P.tolist(), MIX_M.tolist(), MIX_V.tolist())))
    shifted = let(logs, lambda a: let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top))))
    return let(shifted, lambda w: let(F.aggregate(w, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(w, lambda x: x / total)))


def mixture_moments(weights: Column) -> tuple[Column, Column]:
    """Mean and variance of the mixture under given probabilities."""
    mean = dot(weights, doubles(*MIX_M.tolist()))
    second = dot(weights, doubles(*(MIX_V + MIX_M * MIX_M).tolist()))
    return mean, second - mean * mean


def smoothed_level(rows: DataFrame, by: Sequence[str], order: Sequence[str], residual: Column, mu: Column, phi: float = 0.95, sd: float = 0.15, part: int = PART) -> DataFrame:
    """by, t, level and var: the smoothed log variance of every row and its variance, for mu given (constant in a series).

    The components are weighted at mu.  A series may be of any length.
    """
    weights = mixture_weights(F.col("_u"), F.col("_mu"))
    seen = rows.select(*by, *order, log_square(residual).alias("_u"), mu.cast("double").alias("_mu")).withColumn("_w", weights)
    mean, var = mixture_moments(F.col("_w"))
    step = sd * sd
    path = scan.kalman_filter(seen, by, order, F.col("_u") - mean - F.col("_mu"), doubles(1.0), var, F.lit(step), phi, step / (1.0 - phi * phi), part)
    smooth = scan.smoother(path, by, phi, part).select(*by, "t", F.col("mean")[0].alias("_m"), F.col("var")[0].alias("var"))
    levels = seen.groupBy(*by).agg(F.first("_mu").alias("_mu"))
    return scan.with_facts(smooth, levels, by).select(*by, "t", (F.col("_mu") + F.col("_m")).alias("level"), "var")
