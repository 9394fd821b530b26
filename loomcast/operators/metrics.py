"""Forecast scores over long frames, one aggregation each.

`samples` has the group columns, h, actual and sample; all scores are by group.  Means run over h, so that each step
counts the same.  With spread=True groups and series may be of any size: ranks and lags come from range partitions in place
of a buffer or a window for each group.  The scores are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.operators import order_stats
from loomcast.operators.ranges import Ranges

TINY = 1e-8
PINBALL = tuple(round(0.05 * k, 2) for k in range(1, 20))


def quantiles(value: str | Column, probs: Sequence[float]) -> Column:
    """Exact quantiles with linear interpolation."""
    return F.percentile(value, F.array(*map(F.lit, probs)))


def tails(level: float) -> tuple[float, float]:
    """The ends of a central interval; rounded, as 0.1 / 2 and the like aren't exact."""
    a = round((1.0 - level) / 2.0, 12)
    return a, round(1.0 - a, 12)


def point(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, h, actual and the mean of the samples."""
    return samples.groupBy(*by, "h").agg(F.first("actual").alias("actual"), F.avg("sample").alias("mean"))


def rmse(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col("actual") - F.col("mean"), 2))).alias("rmse"))


def smape(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    a, p = F.col("actual"), F.col("mean")
    return points.groupBy(*by).agg(F.avg(200.0 * F.abs(a - p) / F.greatest(F.abs(a) + F.abs(p), F.lit(TINY))).alias("smape"))


def naive_scale(train: DataFrame, by: Sequence[str] = (), order: str = "t", spread: bool = False) -> DataFrame:
    """The mean absolute change from row to row of the training series.  Without groups train is one series, which one task
    puts in order; give by for more, or spread it."""
    scale = F.greatest(F.coalesce(F.avg("_d"), F.lit(0.0)), F.lit(TINY)).alias("scale")
    if spread:
        rows = Ranges(train.select(*by, order, "y"), by, [order]).ranked("_t", {"_before": ("y", 1)})
        return rows.withColumn("_d", F.abs(F.col("y") - F.col("_before"))).groupBy(*by).agg(scale)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    return train.withColumn("_d", F.abs(F.col("y") - F.lag("y").over(w))).groupBy(*by).agg(scale)


def mase(points: DataFrame, train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    errors = points.groupBy(*by).agg(F.avg(F.abs(F.col("actual") - F.col("mean"))).alias("mae"))
    scale = naive_scale(train, by)
    joined = errors.join(scale, list(by)) if by else errors.join(F.broadcast(scale))  # one row each
    return joined.select(*by, (F.col("mae") / F.col("scale")).alias("mase"))


def crps(samples: DataFrame, by: Sequence[str] = (), spread: bool = False) -> DataFrame:
    """Mean over h of mean |x - a| minus half the mean difference between samples, by their order."""
    if spread:
        error = F.avg(F.abs(F.col("sample") - F.col("actual"))) - order_stats.apart()
        return order_stats.summary(samples, [*by, "h"], "sample", more={"c": error}).groupBy(*by).agg(F.avg("c").alias("crps"))
    w = Window.partitionBy(*by, "h")
    ranked = samples.withColumn("_i", F.row_number().over(w.orderBy("sample"))).withColumn("_s", F.count("*").over(w))
    spread = (2.0 * F.col("_i") - F.col("_s") - 1.0) * F.col("sample")
    each = ranked.groupBy(*by, "h").agg((F.avg(F.abs(F.col("sample") - F.col("actual"))) - F.sum(spread) / F.pow(F.count("*").cast("double"), F.lit(2.0))).alias("c"))
    return each.groupBy(*by).agg(F.avg("c").alias("crps"))


def stepwise(samples: DataFrame, by: Sequence[str], probs: Sequence[float], spread: bool = False) -> DataFrame:
    """by, h, actual and q, the quantiles of the samples."""
    if spread:
        return order_stats.summary(samples, [*by, "h"], "sample", probs, {"actual": F.max("actual")})
    return samples.groupBy(*by, "h").agg(F.first("actual").alias("actual"), quantiles("sample", probs).alias("q"))


def pinball(samples: DataFrame, by: Sequence[str] = (), probs: Sequence[float] = PINBALL, spread: bool = False) -> DataFrame:
    each = stepwise(samples, by, probs, spread).withColumnRenamed("actual", "a")
    loss = F.zip_with(F.col("q"), F.array(*map(F.lit, probs)), lambda q, p: F.greatest(p * (F.col("a") - q), (p - 1.0) * (F.col("a") - q)))
    return each.withColumn("l", loss).select(*by, F.explode("l").alias("l")).groupBy(*by).agg(F.avg("l").alias("pinball"))


def intervals(samples: DataFrame, by: Sequence[str] = (), level: float = 0.9, spread: bool = False) -> DataFrame:
    """by, h, actual, lower and upper of the central interval."""
    each = stepwise(samples, by, tails(level), spread)
    return each.select(*by, "h", "actual", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def coverage(bounds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return bounds.groupBy(*by).agg(F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"))


def interval_score(bounds: DataFrame, by: Sequence[str] = (), level: float = 0.9) -> DataFrame:
    a, lo, hi = F.col("actual"), F.col("lower"), F.col("upper")
    miss = F.when(a < lo, lo - a).when(a > hi, a - hi).otherwise(0.0)
    return bounds.groupBy(*by).agg(F.avg(hi - lo + miss * (2.0 / round(1.0 - level, 12))).alias("interval_score"))


def evaluate(samples: DataFrame, train: DataFrame, by: Sequence[str] = (), level: float = 0.9, spread: bool = False) -> DataFrame:
    """All scores of each group in one row.  Without groups everything is one.

    The samples are shuffled once, by group and step; one aggregation makes a row for each step, a second the scores.
    Spread, they are sorted over range partitions once, and one aggregation of ranked rows makes the row for each step.
    """
    keys = list(by) or ["_all"]
    if not by:
        samples, train = samples.withColumn("_all", F.lit(0)), train.withColumn("_all", F.lit(0))
    a, m, q = F.col("actual"), F.col("mean"), F.col("q")
    probs, mean = [*PINBALL, *tails(level)], F.avg("sample")
    away = F.avg(F.abs(F.col("sample") - F.col("actual")))
    if spread:
        steps = order_stats.summary(samples, [*keys, "h"], "sample", probs, {"actual": F.max("actual"), "mean": mean, "crps": away - order_stats.apart()})
    else:
        w = Window.partitionBy(*keys, "h")
        ranked = samples.withColumn("_i", F.row_number().over(w.orderBy("sample"))).withColumn("_s", F.count("*").over(w))
        apart = away - F.sum((2.0 * F.col("_i") - F.col("_s") - 1.0) * F.col("sample")) / F.pow(F.count("*").cast("double"), F.lit(2.0))
        steps = ranked.groupBy(*keys, "h").agg(F.first("actual").alias("actual"), mean.alias("mean"), apart.alias("crps"), quantiles("sample", probs).alias("q"))
    lo, hi = q[len(PINBALL)], q[len(PINBALL) + 1]
    miss = F.when(a < lo, lo - a).when(a > hi, a - hi).otherwise(0.0)
    loss = F.aggregate(F.zip_with(F.slice(q, 1, len(PINBALL)), F.array(*map(F.lit, PINBALL)), lambda v, p: F.greatest(p * (a - v), (p - 1.0) * (a - v))), F.lit(0.0), lambda s, v: s + v)
    out = steps.groupBy(*keys).agg(
        F.sqrt(F.avg(F.pow(a - m, 2))).alias("rmse"),
        F.avg(200.0 * F.abs(a - m) / F.greatest(F.abs(a) + F.abs(m), F.lit(TINY))).alias("smape"),
        F.avg(F.abs(a - m)).alias("mae"),
        F.avg("crps").alias("crps"),
        F.avg(loss / float(len(PINBALL))).alias("pinball"),
        F.avg(a.between(lo, hi).cast("double")).alias("coverage"),
        F.avg(hi - lo + miss * (2.0 / round(1.0 - level, 12))).alias("interval_score"),
    )
    out = out.join(naive_scale(train, keys, spread=spread), keys).select(*keys, "rmse", "smape", (F.col("mae") / F.col("scale")).alias("mase"), "crps", "pinball", "coverage", "interval_score")
    return out if by else out.drop("_all")


def component_fidelity(draws: DataFrame, truth: DataFrame, by: Sequence[str] = ("unique_id",), level: float = 0.9) -> DataFrame:
    """by, component, rmse of the posterior mean and coverage; draws and truth have by, t and a column for each component.

    Rows of truth without draws (those lost to lags) don't count.
    """
    names = ("trend", "seasonal", "generic")
    long = lambda df, value, *more: df.select(*by, "t", *more, F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias(value)) for c in names))).alias("c")).select(*by, "t", *more, "c.*")
    bands = long(draws, "value", "draw").groupBy(*by, "component", "t").agg(F.avg("value").alias("mean"), quantiles("value", tails(level)).alias("q"))
    joined = bands.join(long(truth, "actual"), [*by, "component", "t"])
    return joined.groupBy(*by, "component").agg(
        F.sqrt(F.avg(F.pow(F.col("mean") - F.col("actual"), 2))).alias("rmse"),
        F.avg(F.col("actual").between(F.col("q")[0], F.col("q")[1]).cast("double")).alias("coverage"),
    )


def trial_summary(trials: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    return trials.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values))
