"""Queries over tables as one long series or one large group, by range partitions in place of windows and buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.operators import diagnostics, forecast, interpret, metrics, order_stats
from loomcast.plans.queries import _SAMPLES, config, designed, long, seasons, waves
from loomcast.plans.registry import query, read, sql, tidy
from loomcast.sources import series as sources

#: All events are one series.
EVENTS = """s AS (SELECT 'events' AS unique_id, row_number() OVER (ORDER BY ts, value) - 1 AS t, ts AS ds, value AS y FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.lit("events").alias("unique_id"), F.col("ts").alias("ds"), F.col("value").alias("y"))
    return sources.series(rows, spread=True)


@query(sql(f"{EVENTS}, x AS (SELECT * FROM s)", "unique_id", "t", "y", "ds"))
def q_long_series(spark, sf_dir):
    return tidy(events(spark, sf_dir))


def lagged(*lags: int) -> str:
    """x: unique_id, t, pos, val of the values so many rows before, where all lags exist."""
    wide = ", ".join(f"lag(y, {k}) OVER (ORDER BY t) AS lag{k}" for k in lags)
    return f"g AS (SELECT *, {wide} FROM s), x AS (" + " UNION ALL ".join(f"SELECT unique_id, t, {pos} AS pos, lag{k} AS val FROM g WHERE t >= {max(lags)}" for pos, k in enumerate(lags)) + ")"


@query(sql(f"{EVENTS}, {lagged(1, 2, 24, 300)}", "unique_id", "t pos", "val"))
def q_long_lags(spark, sf_dir):
    """The generic design of one series that no task holds whole."""
    return tidy(long(designed(events(spark, sf_dir), config(lags=(1, 2, 24, 300)), spread=True)[0], "x_ge"))


_ROWS = f"""{EVENTS}, g AS (SELECT *, lag(y, 1) OVER (ORDER BY t) AS lag1 FROM s),
c AS (SELECT count(*) + 1 AS n, avg(y) AS y_mean, stddev_pop(y) AS y_std FROM g WHERE t >= 1),
x AS (SELECT t, (y - y_mean) / y_std AS z, t / (n - 1)::DOUBLE AS u, {waves((24, 1))[0]} AS s1, lag1 FROM g, c WHERE t >= 1)"""


@query(sql(_ROWS, "", "t", "z u s1 lag1"))
def q_long_design(spark, sf_dir):
    d = designed(events(spark, sf_dir), config(seasonal=seasons((24, 1)), lags=(1,)), spread=True)[0]
    return tidy(d.select("t", "z", F.col("x_tr")[1].alias("u"), F.col("x_se")[0].alias("s1"), F.col("x_ge")[0].alias("lag1")))


_LAGS = (1, 2, 3, 10, 100)


@query(sql(f"""e AS (SELECT event_id AS draw, value - avg(value) OVER () AS d, var_pop(value) OVER () AS v, row_number() OVER (ORDER BY event_id) AS i FROM events),
x AS (SELECT 'all' AS chain, k AS lag, avg(a.d * b.d) / any_value(a.v) AS rho FROM (VALUES {', '.join(f'({k})' for k in _LAGS)}) r(k), e a JOIN e b ON b.i = a.i + k GROUP BY k)""", "chain", "lag", "rho"))  # fmt: skip
def q_long_autocorr(spark, sf_dir):
    chain = read(spark, sf_dir, "events").select(F.lit("all").alias("chain"), F.col("event_id").alias("draw"), "value")
    return tidy(diagnostics.autocorrelation(chain, _LAGS, spread=True))


@query(sql(f"{EVENTS}, x AS (SELECT greatest(avg(abs(d)), 1e-8) AS scale FROM (SELECT y - lag(y) OVER (ORDER BY t) AS d FROM s))", "", "", "scale"))
def q_long_naive_scale(spark, sf_dir):
    return tidy(metrics.naive_scale(events(spark, sf_dir), spread=True))


# ---- one group ------------------------------------------------------------------------------------------------------

_PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999)
_QUANTILES = f"q AS (SELECT quantile_cont(l_extendedprice, {list(_PROBS)}) AS q FROM lineitem), x AS (SELECT [{', '.join(map(str, _PROBS))}][j] AS prob, q[j] AS val FROM q, range(1, {len(_PROBS) + 1}) r(j))"


@query(sql(_QUANTILES, "", "", "prob val"))
def q_long_quantiles(spark, sf_dir):
    """Exact quantiles of all of lineitem as one group."""
    each = order_stats.summary(read(spark, sf_dir, "lineitem").select("l_extendedprice"), [], "l_extendedprice", _PROBS)
    pairs = F.arrays_zip(F.array(*map(F.lit, _PROBS)).alias("prob"), F.col("q").alias("val"))
    return tidy(each.select(F.explode(pairs).alias("e")).select("e.prob", "e.val"))


_LINES = "e AS (SELECT l_returnflag AS unique_id, l_linenumber::BIGINT AS h, l_linenumber + 100 AS t, l_extendedprice AS sample FROM lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as samples of a step for each line number: few groups, each with a share of all rows."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_returnflag").alias("unique_id"), F.col("l_linenumber").cast("long").alias("h"), (F.col("l_linenumber") + 100).cast("long").alias("t"), F.col("l_extendedprice").alias("sample"))


@query(sql(f"{_LINES}, x AS (SELECT unique_id, h, t, quantile_cont(sample, 0.1) AS lower, quantile_cont(sample, 0.9) AS upper FROM e GROUP BY ALL)", "unique_id", "h t", "lower upper", digits=4))
def q_long_interval(spark, sf_dir):
    return tidy(forecast.interval(lines(spark, sf_dir), 0.8, spread=True), 4)


@query(sql(f"{_LINES}, x AS (SELECT unique_id, avg(sample) AS mean, quantile_cont(sample, 0.05) AS lower, quantile_cont(sample, 0.95) AS upper FROM e GROUP BY ALL)", "unique_id", "", "mean lower upper", digits=4))
def q_long_bands(spark, sf_dir):
    return tidy(interpret.bands(lines(spark, sf_dir), ["unique_id"], "sample", spread=True), 4)


_ALL = """s AS (SELECT 'all' AS unique_id, 0 AS h, 30000e0 AS actual, l_extendedprice AS sample FROM lineitem),
"""
_BATTERY = _ALL + _SAMPLES[_SAMPLES.index("p AS (") :].replace(
    "y AS (SELECT event_type AS unique_id, date_trunc('day', ts) AS t, avg(value) AS y FROM events GROUP BY 1, 2)",
    "y AS (SELECT 'all' AS unique_id, row_number() OVER (ORDER BY ts, value) AS t, value AS y FROM events)",
)
_SCORES = "rmse smape mase crps pinball coverage interval_score"


@query(sql(f"{_BATTERY}, x AS (SELECT * FROM {' JOIN '.join(f'm_{m}' + (' USING (unique_id)' if k else '') for k, m in enumerate(_SCORES.split()))})", "unique_id", "", _SCORES))
def q_long_battery(spark, sf_dir):
    """All scores with every line of lineitem as a sample of one step, and all events as the training series."""
    s = read(spark, sf_dir, "lineitem").select(F.lit("all").alias("unique_id"), F.lit(0).alias("h"), F.lit(30000.0).alias("actual"), F.col("l_extendedprice").alias("sample"))
    train = events(spark, sf_dir).select(F.lit("all").alias("unique_id"), "t", "y")
    return tidy(metrics.evaluate(s, train, ["unique_id"], spread=True))
