"""Order statistics of groups of any size.

`percentile` holds all distinct values of a group in one buffer, and a rank by a window puts a group into one task.  Here
ranks come from range partitions (ranges.Ranges); what is asked of a group is then one aggregation over ranked rows, whose
partial sums are made before the shuffle.  The results are the exact ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.operators.ranges import PART, Ranges

#: Groups whose facts (a row each) go by broadcast.
FEW = 500_000


def with_facts(rows: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with the columns of facts, which has one row for each group; null keys match.

    Up to FEW groups go by broadcast; more meet in a shuffle, in which Spark splits the large ones.
    """
    if not by:  # one row
        one = facts.first()
        return rows.withColumns({c: F.lit(one[c]).cast(t) for c, t in facts.dtypes})
    keyed = facts.withColumnsRenamed({c: f"_by_{c}" for c in by})
    few = facts.limit(FEW + 1).count() <= FEW
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return rows.join(F.broadcast(keyed) if few else keyed, reduce(and_, same)).drop(*(f"_by_{c}" for c in by))


def ranked(df: DataFrame, by: Sequence[str], value: str, part: int = PART) -> DataFrame:
    """Rows with a value, _r (their rank by value in the group, from 0) and _n (rows of the group)."""
    rows = df.where(F.col(value).isNotNull())
    return with_facts(Ranges(rows, by, [value], part).ranked("_r"), rows.groupBy(*by).agg(F.count("*").alias("_n")), by)


def at_probability(value: str, prob: float) -> tuple[Column, Column]:
    """Aggregates of ranked rows: the values at the two ranks about a quantile."""
    place = (F.col("_n") - 1) * F.lit(float(prob))
    return F.max(F.when(F.col("_r") == F.floor(place), F.col(value))), F.max(F.when(F.col("_r") == F.ceil(place), F.col(value)))


def summary(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float] = (), more: Mapping[str, Column] | None = None, part: int = PART) -> DataFrame:
    """by, more and q: the quantiles at probs with linear interpolation, as an array.  more are aggregates, which may use
    _r and _n."""
    ends = [c.alias(f"_{side}{k}") for k, p in enumerate(probs) for side, c in zip(("lo", "hi"), at_probability(value, p))]
    each = ranked(df, by, value, part).groupBy(*by).agg(F.count("*").alias("_n"), *ends, *(c.alias(k) for k, c in (more or {}).items()))

    def between(k: int, p: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo{k}"), F.col(f"_hi{k}")
        return low + (high - low) * (place - F.floor(place))

    return each.select(*by, *(more or {}), F.array(*(between(k, p) for k, p in enumerate(probs))).cast("array<double>").alias("q"))


def apart(value: str = "sample") -> Column:
    """An aggregate of ranked rows: half the mean difference between any two values of the group."""
    x, n = F.col(value), F.count("*").cast("double")
    return (2.0 * F.sum((F.col("_r") + 1.0) * x) - (n + 1.0) * F.sum(x)) / (n * n)
