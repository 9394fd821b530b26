"""Bands, decompositions, importances and responses, all by aggregation over draws."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomcast.functions import bases
from loomcast.operators import order_stats
from loomcast.operators.metrics import quantiles, tails
from loomcast.operators.trees import Forests

DRAW = ("unique_id", "chain", "draw")
COMPONENTS = ("trend", "seasonal", "generic")


def bands(draws: DataFrame, by: Sequence[str], value: str = "value", level: float = 0.9, spread: bool = False) -> DataFrame:
    """by, mean, lower and upper over the draws; spread, groups may be of any size (order_stats)."""
    if spread:
        each = order_stats.summary(draws, list(by), value, tails(level), {"mean": F.avg(value)})
        return each.select(*by, "mean", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))
    each = draws.groupBy(*by).agg(F.avg(value).alias("mean"), quantiles(value, tails(level)).alias("q"))
    return each.select(*by, "mean", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def component_draws(posterior: DataFrame, state: DataFrame) -> DataFrame:
    """unique_id, chain, draw, t and the standardised components in sample."""
    rows = posterior.select(*DRAW, F.posexplode(F.arrays_zip(*COMPONENTS)).alias("i", "c"))
    return rows.join(state.select("unique_id", "max_lag"), "unique_id").select(*DRAW, (F.col("i") + F.col("max_lag")).alias("t"), *(F.coalesce(F.col(f"c.{c}"), F.lit(0.0)).alias(c) for c in COMPONENTS))


def residuals(draws: DataFrame, design: DataFrame) -> DataFrame:
    """unique_id, chain, draw, t and residual: what the parts of a draw leave of the standardised target.

    draws are those of component_draws.  Series and draws meet by (series, row), so that no series gathers in one task.
    """
    joined = draws.join(design.select("unique_id", "t", "z"), ["unique_id", "t"])
    return joined.select(*DRAW, "t", (F.col("z") - F.col("trend") - F.col("seasonal") - F.col("generic")).alias("residual"))


def residual_moments(left: DataFrame) -> DataFrame:
    """unique_id, chain, draw, n, mean, variance (about 0) and largest size of the residuals of each draw."""
    r = F.col("residual")
    return left.groupBy(*DRAW).agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.avg(r * r).alias("variance"), F.max(F.abs(r)).alias("most"))


def unscaled(draws: DataFrame, state: DataFrame) -> DataFrame:
    """Component draws on the scale of y, with their sum as fitted; the mean of y goes to the trend."""
    rows = draws.join(state.select("unique_id", "y_mean", "y_std"), "unique_id")
    mean, sd = F.col("y_mean"), F.col("y_std")
    whole = mean + sd * (F.col("trend") + F.col("seasonal") + F.col("generic"))
    kept = [c for c in draws.columns if c not in COMPONENTS]
    return rows.select(*kept, (mean + sd * F.col("trend")).alias("trend"), (sd * F.col("seasonal")).alias("seasonal"), (sd * F.col("generic")).alias("generic"), whole.alias("fitted"))


def long_components(wide: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("value")) for c in names))
    return wide.select(*by, F.explode(parts).alias("p")).select(*by, "p.component", "p.value")


def decomposition(draws: DataFrame, state: DataFrame, level: float = 0.9) -> DataFrame:
    """unique_id, component (fitted too), x, mean, lower, upper of standardised component draws."""
    long = long_components(unscaled(draws, state).withColumnRenamed("t", "x"), ("unique_id", "x"), (*COMPONENTS, "fitted"))
    return bands(long, ("unique_id", "component", "x"), level=level)


def split_importance(posterior: DataFrame, names: DataFrame, block: str, level: float = 0.9) -> DataFrame:
    """unique_id, feature, mean, lower, upper and inclusion_prob of the number of splits on each feature of a forest.

    Features that a draw doesn't use count as 0 there.  A block without trees is an error.
    """
    trees = f"{block}_trees"
    if trees not in posterior.columns:
        raise ValueError(f"block {block!r} is not a forest")
    some = posterior.where(F.size(trees) > 0)
    if not some.head(1):
        raise ValueError(f"block {block!r} is not a forest")
    features = names.where(F.col("block") == block).select("unique_id", "pos", F.col("name").alias("feature"))
    counts = some.join(features, "unique_id").select("unique_id", "feature", bases.split_count(F.col(trees), F.col("pos")).cast("double").alias("value"))
    each = bands(counts, ("unique_id", "feature"), level=level)
    used = counts.groupBy("unique_id", "feature").agg(F.avg((F.col("value") > 0).cast("double")).alias("inclusion_prob"))
    return each.join(used, ["unique_id", "feature"])


ROWS, DRAWS = 4096, 4096  # training rows and draws of a series that meet at once


def partial_dependence(posterior: DataFrame, design: DataFrame, state: DataFrame, block: str, feature: int, grid: Sequence[float], level: float = 0.9) -> DataFrame:
    """unique_id, x, mean, lower, upper: the forest's mean over the training rows with one feature set to each x.

    On the scale of y without its mean.  A task holds a block of about ROWS training rows and one of about DRAWS draws of
    their series, whose forests they walk; sums over blocks of rows give the mean of each draw before draws meet.
    """
    column = {"trend": "x_tr", "seasonal": "x_se", "generic": "x_ge"}[block]
    grown = posterior.where(F.size(f"{block}_trees") > 0).select(*DRAW, F.col(f"{block}_trees").alias("trees"))
    blocks = lambda df, most, name: df.groupBy("unique_id").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    count = blocks(design, ROWS, "blocks").join(blocks(grown, DRAWS, "groups"), "unique_id")
    dealt_by = F.xxhash64("t" if "t" in design.columns else column)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = design.join(count, "unique_id").select("unique_id", F.pmod(dealt_by, F.col("blocks")).cast("int").alias("part"), every("groups").alias("of"), F.col(column).alias("row"))
    draws = grown.join(count, "unique_id").withColumn("of", F.pmod(F.xxhash64("chain", "draw"), F.col("groups")).cast("int")).withColumn("part", every("blocks")).drop("blocks", "groups")
    points = [float(g) for g in grid]

    def walk(key: tuple, own: pa.Table, drawn: pa.Table) -> pa.Table:
        out = []
        if own.num_rows:
            x = own["row"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1).copy()
            for part in drawn.to_batches():
                forests = Forests.of(part.column("trees"))
                for g in points:
                    x[:, feature] = g
                    n = part.num_rows
                    out.append(pa.RecordBatch.from_arrays([part.column("unique_id"), part.column("chain"), part.column("draw"), pa.array(np.full(n, g)), pa.array(forests.sums(x)), pa.array(np.full(n, len(x), np.int64))], schema=arrow))
        return pa.Table.from_batches(out, schema=arrow)

    schema = T.StructType([*(posterior.schema[c] for c in DRAW), T.StructField("x", T.DoubleType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)
    sums = rows.groupBy("unique_id", "part", "of").cogroup(draws.groupBy("unique_id", "part", "of")).applyInArrow(walk, schema)
    means = sums.groupBy(*DRAW, "x").agg((F.sum("s") / F.sum("n")).alias("m")).join(state.select("unique_id", "y_std"), "unique_id")
    return bands(means.withColumn("value", F.col("m") * F.col("y_std")), ("unique_id", "x"), level=level)


def response(baseline: DataFrame, shocked: DataFrame) -> DataFrame:
    """unique_id, chain, draw, h, value: shocked less baseline samples, draw by draw."""
    keys = [*DRAW, "h"]
    a = baseline.select(*keys, F.col("sample").alias("a"))
    b = shocked.select(*keys, F.col("sample").alias("b"))
    return a.join(b, keys).select(*keys, (F.col("b") - F.col("a")).alias("value"))
