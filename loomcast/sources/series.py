"""Series sources: any DataFrame becomes rows (unique_id, t, ds, y, x_*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.operators.ranges import Ranges


def _whole(c: Column, what: str, who: Column) -> Column:
    """c as a double; a null or NaN stops the query with the name of its series."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d), F.raise_error(F.concat(F.lit(f"{what} has a null or NaN in series "), who)).cast("double")).otherwise(d)


def series(
    df: DataFrame,
    target: str = "y",
    time: str | None = "ds",
    unique_id: str | None = "unique_id",
    exog: Sequence[str] = (),
    parse_time: bool = True,
    order: str | None = None,
    spread: bool = False,
) -> DataFrame:
    """unique_id, t, ds, y and x_<name> for each covariate; t is the rank of a row in its series, from 0.

    Gaps in time are ignored, as t counts rows.  Without an id column everything is one series.  Rows are ordered by
    `order`, or else by time; ties in time by the target.  Null or NaN targets and covariates stop the query when it runs.
    spread numbers the rows of a series over range partitions, so that it may be of any length; rows are then read at once.
    """
    who = F.lit("series") if unique_id is None else F.coalesce(F.col(unique_id).cast("string"), F.lit(""))
    ds = F.lit(None).cast("timestamp") if time is None else F.to_timestamp(time) if parse_time else F.col(time)
    by = F.col(order or time) if (order or time) else F.lit(0)
    window = Window.partitionBy("unique_id").orderBy("_by", "y")
    missing = [c for c in exog if c not in df.columns]
    if missing:
        raise ValueError(f"missing covariates: {', '.join(missing)}")
    named = dict.fromkeys(exog)
    flat = df.select(who.alias("unique_id"), by.alias("_by"), ds.alias("ds"), _whole(F.col(target), target, who).alias("y"), *(_whole(F.col(c), c, who).alias(f"x_{c}") for c in named))
    if spread:
        return Ranges(flat, ["unique_id"], ["_by", "y"]).ranked("t").select("unique_id", "t", "ds", "y", *(f"x_{c}" for c in named))
    return flat.select("unique_id", (F.row_number().over(window) - 1).alias("t"), "ds", "y", *(f"x_{c}" for c in named))


def single(df: DataFrame, unique_id: str) -> DataFrame:
    """df if it holds one series at most; else ValueError.  For callers that expect one series."""
    if df.select(F.count_distinct(unique_id)).first()[0] > 1:
        raise ValueError("more than one series")
    return df


MONDAY = "1970-01-05"  # weeks are counted from here


def business_day(ds: Column) -> Column:
    """The number of the Monday-to-Friday day that ds falls on; Saturdays and Sundays count as the Friday before."""
    days = F.datediff(ds, F.lit(MONDAY).cast("date"))
    return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(4))


def frequency(s: DataFrame) -> DataFrame:
    """unique_id, unit, months, seconds: the step in time of each series.

    unit is month_end if all rows fall on the last day of a month, month if all fall on the same day of the month (both
    at one time of day, and no month twice), with the commonest step in months, the smaller on a tie; business_day if
    every row is the next day from Monday to Friday after the one before it and a weekend lies between; else second, with
    the commonest step in seconds.
    """
    w = Window.partitionBy("unique_id").orderBy("t")
    prev = F.lag("ds").over(w)
    months = (F.year("ds") * 12 + F.month("ds")) - (F.year(prev) * 12 + F.month(prev))
    steps = s.where("ds IS NOT NULL").withColumn("months", months).withColumn("seconds", F.unix_timestamp("ds") - F.unix_timestamp(prev))
    steps = steps.withColumn("clock", F.unix_timestamp("ds") % 86400).withColumn("work", business_day(F.col("ds")) - business_day(prev))
    same = lambda c: F.min(c) == F.max(c)
    facts = steps.groupBy("unique_id").agg(
        (same("clock") & same(F.dayofmonth("ds")) & (F.min("months") > 0)).alias("same_day"),
        (same("clock") & F.bool_and(F.to_date("ds") == F.last_day("ds")) & (F.min("months") > 0)).alias("last_day"),
        (same("clock") & F.bool_and(F.weekday("ds") < 5) & (F.min("work") == 1) & (F.max("work") == 1) & (F.max("seconds") > 86400)).alias("working"),
    )
    counted = steps.where("seconds IS NOT NULL").groupBy("unique_id", "months", "seconds").agg(F.count("*").alias("c"))
    by_second = counted.groupBy("unique_id", "seconds").agg(F.sum("c").alias("c"))
    by_month = counted.groupBy("unique_id", "months").agg(F.sum("c").alias("c"))
    top_s = by_second.groupBy("unique_id").agg(F.min_by("seconds", F.struct(-F.col("c"), "seconds")).alias("seconds"))
    top_m = by_month.groupBy("unique_id").agg(F.min_by("months", F.struct(-F.col("c"), "months")).alias("months"))
    unit = F.when(F.col("last_day"), "month_end").when(F.col("same_day"), "month").when(F.col("working"), "business_day").otherwise("second")
    joined = facts.join(top_s, "unique_id", "left").join(top_m, "unique_id", "left").withColumn("unit", unit)
    whole = F.col("unit").isin("month", "month_end")
    return joined.select("unique_id", "unit", F.when(whole, F.col("months")).otherwise(0).cast("int").alias("months"), F.when(F.col("unit") == "second", F.coalesce("seconds", F.lit(0))).otherwise(0).cast("long").alias("seconds"))


def moved(ds: Column, ahead: Column, unit: Column, months: Column, seconds: Column) -> Column:
    """ds moved on by `ahead` steps of a frequency; null where the step is unknown."""
    by_month = ds + F.make_ym_interval(F.lit(0), ahead * months)
    clock = F.make_dt_interval(secs=F.unix_timestamp(ds) % 86400)
    month_end = F.last_day(by_month).cast("timestamp") + clock
    day = business_day(ds) + ahead
    working = F.date_add(F.lit(MONDAY).cast("date"), (F.floor(day / 5) * 7 + F.pmod(day, F.lit(5))).cast("int")).cast("timestamp") + clock
    by_second = F.when(seconds > 0, F.timestamp_seconds(F.unix_timestamp(ds) + ahead * seconds))
    return F.when(unit == "month", by_month).when(unit == "month_end", month_end).when(unit == "business_day", working).otherwise(by_second)


def densified(df: DataFrame, time: str = "ds", unique_id: str = "unique_id", step: str = "INTERVAL 1 MONTH") -> DataFrame:
    """Every step from each series' first time to its last, with df's other columns where there is a row, else null."""
    ends = df.groupBy(unique_id).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    grid = ends.select(unique_id, F.explode(F.sequence("a", "b", F.expr(step))).alias(time))
    return grid.join(df, [unique_id, time], "left")
