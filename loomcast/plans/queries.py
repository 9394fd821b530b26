"""The registered queries over the TPC-H-like tables, each over its whole tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.config import CALENDAR_FIELDS, ERROR_MODES, TREND_MODES, GenericConfig, MCMCConfig, ModelConfig, SeasonalConfig, SeasonalPeriod, TrendConfig, make_config
from loomcast.functions import bases
from loomcast.operators import design as designs
from loomcast.operators import diagnostics, fit, forecast, interpret, metrics
from loomcast.plans.model import SeriesModel
from loomcast.plans.registry import query, sql, tidy
from loomcast.plans.registry import read as _read
from loomcast.sources import artifacts
from loomcast.sources import series as sources
from loomcast.sources import synthetic

# ---- series ---------------------------------------------------------------------------------------------------------

MONTHLY = """m AS (SELECT 'orders' AS unique_id, date_trunc('month', o_orderdate) AS ds, sum(o_totalprice) AS y, count(*) AS n_orders
  FROM orders GROUP BY ALL),
s AS (SELECT unique_id, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS t, ds, y, n_orders::DOUBLE AS n_orders FROM m)"""
PANEL = """m AS (SELECT n_name AS unique_id, date_trunc('month', o_orderdate) AS ds, sum(o_totalprice) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
s AS (SELECT unique_id, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS t, ds, y FROM m)"""
HOURLY = """m AS (SELECT 'events' AS unique_id, date_trunc('hour', ts) AS ds, avg(value) AS y FROM events GROUP BY ALL),
s AS (SELECT unique_id, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS t, ds, y FROM m)"""
#: n, u = t / (n - 1) and the standardised z of all rows of s.
SCALED = """c AS (SELECT unique_id, count(*) AS n, avg(y) AS y_mean, coalesce(nullif(stddev_pop(y), 0), 1) AS y_std FROM s GROUP BY unique_id),
z AS (SELECT s.*, n, y_mean, y_std, t / greatest(n - 1, 1)::DOUBLE AS u, (y - y_mean) / y_std AS z FROM s JOIN c USING (unique_id))"""


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    sums = orders.groupBy(F.date_trunc("month", "o_orderdate").alias("ds")).agg(F.sum("o_totalprice").alias("y"), F.count("*").alias("n_orders"))
    return sources.series(sums.withColumn("unique_id", F.lit("orders")), exog=["n_orders"])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    customers = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    sums = joined.groupBy(F.col("n_name").alias("unique_id"), F.date_trunc("month", "o_orderdate").alias("ds")).agg(F.sum("o_totalprice").alias("y"))
    return sources.series(sums)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("ds")).agg(F.avg("value").alias("y"))
    return sources.series(events.withColumn("unique_id", F.lit("events")))


def config(trend: TrendConfig | None = None, seasonal: SeasonalConfig | None = None, lags: Sequence[int] = (), exog: Sequence[str] = ()) -> ModelConfig:
    return ModelConfig(trend or TrendConfig("linear"), seasonal or SeasonalConfig(), GenericConfig(tuple(lags), tuple(exog)))


def designed(rows: DataFrame, cfg: ModelConfig, spread: bool = False) -> tuple[DataFrame, DataFrame]:
    state = designs.feature_state(rows, cfg)
    return designs.design(rows, state, cfg, spread), state


def long(df: DataFrame, column: str, *by: str) -> DataFrame:
    return df.select(*(by or ("unique_id", "t")), F.posexplode(column).alias("pos", "val"))


@query(sql(f"{MONTHLY}, x AS (SELECT * FROM s)", "unique_id", "t", "y n_orders", "ds", 4))
def q_series_orders_monthly(spark, sf_dir):
    return tidy(monthly(spark, sf_dir).withColumnRenamed("x_n_orders", "n_orders"), 4)


@query(sql(f"{HOURLY}, x AS (SELECT * FROM s)", "unique_id", "t", "y", "ds"))
def q_series_events_hourly(spark, sf_dir):
    return tidy(hourly(spark, sf_dir))


@query(sql(f"{PANEL}, x AS (SELECT * FROM s)", "unique_id", "t", "y", "ds", 4))
def q_panel_nation_month(spark, sf_dir):
    return tidy(panel(spark, sf_dir), 4)


_STEP = """p AS (SELECT unique_id, ds, lag(ds) OVER (PARTITION BY unique_id ORDER BY t) AS prev FROM s),
d AS (SELECT unique_id, ds, (year(ds) * 12 + month(ds)) - (year(prev) * 12 + month(prev)) AS months, epoch(ds) - epoch(prev) AS seconds,
  epoch(ds) % 86400 AS clock, day(ds) AS dom, ds::DATE = last_day(ds::DATE) AS last, isodow(ds) AS dow,
  floor(date_diff('day', DATE '1970-01-05', ds::DATE) / 7) * 5 + least(isodow(ds) - 1, 4) AS work FROM p),
w AS (SELECT *, work - lag(work) OVER (PARTITION BY unique_id ORDER BY ds) AS step FROM d),
e AS (SELECT unique_id, min(clock) = max(clock) AND min(dom) = max(dom) AND min(months) > 0 AS even, min(clock) = max(clock) AND bool_and(last) AND min(months) > 0 AS ends,
  min(clock) = max(clock) AND max(dow) < 6 AND min(step) = 1 AND max(step) = 1 AND max(seconds) > 86400 AS working FROM w GROUP BY 1),
a AS (SELECT unique_id, arg_min(seconds, (-c, seconds)) AS seconds FROM (SELECT unique_id, seconds, count(*) AS c FROM d WHERE seconds IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT unique_id, arg_min(months, (-c, months)) AS months FROM (SELECT unique_id, months, count(*) AS c FROM d WHERE seconds IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT unique_id, CASE WHEN ends THEN 'month_end' WHEN even THEN 'month' WHEN working THEN 'business_day' ELSE 'second' END AS unit FROM e),
x AS (SELECT u.unique_id, unit, CASE WHEN unit IN ('month', 'month_end') THEN months ELSE 0 END AS months, CASE WHEN unit = 'second' THEN seconds ELSE 0 END AS seconds
  FROM u JOIN a USING (unique_id) JOIN b USING (unique_id))"""


@query(sql(f"{PANEL}, {_STEP}", "unique_id unit", "months seconds"))
def q_frequency_panel(spark, sf_dir):
    return tidy(sources.frequency(panel(spark, sf_dir)))


@query(sql(f"{HOURLY}, {_STEP}", "unique_id unit", "months seconds"))
def q_frequency_hourly(spark, sf_dir):
    return tidy(sources.frequency(hourly(spark, sf_dir)))


@query(sql(f"""{PANEL}, g AS (SELECT unique_id, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS ds FROM (SELECT unique_id, min(ds) AS a, max(ds) AS b FROM s GROUP BY 1)),
x AS (SELECT unique_id, g.ds, y FROM g LEFT JOIN s USING (unique_id, ds))""", "unique_id", "", "y", "ds", 4))  # fmt: skip
def q_densified_panel(spark, sf_dir):
    return tidy(sources.densified(panel(spark, sf_dir).select("unique_id", "ds", "y")), 4)


@query(sql(f"{PANEL}, {SCALED}, x AS (SELECT * FROM z)", "unique_id", "t n", "u"))
def q_time_normalise(spark, sf_dir):
    rows = panel(spark, sf_dir)
    state = designs.feature_state(rows, config())
    return tidy(rows.join(state, "unique_id").select("unique_id", "t", "n", (F.col("t") / F.col("t_scale")).alias("u")))


@query(sql(f"{PANEL}, {SCALED}, x AS (SELECT * FROM z)", "unique_id", "t", "z"))
def q_standardise(spark, sf_dir):
    return tidy(designed(panel(spark, sf_dir), config())[0].select("unique_id", "t", "z"))


# ---- bases ----------------------------------------------------------------------------------------------------------


def unpivoted(values: Sequence[str], by: str = "unique_id, t", source: str = "z") -> str:
    """x(by, pos, val) from expressions over rows of source."""
    return "x AS (" + " UNION ALL ".join(f"SELECT {by}, {k} AS pos, ({v})::DOUBLE AS val FROM {source}" for k, v in enumerate(values)) + ")"


def _basis(values: Sequence[str], base: str = PANEL, more: str = SCALED) -> str:
    return sql(f"{base}, {more}, {unpivoted(values)}", "unique_id", "t pos", "val")


@query(_basis(["1", "u"]))
def q_trend_linear(spark, sf_dir):
    return tidy(long(designed(panel(spark, sf_dir), config())[0], "x_tr"))


@query(_basis(["1", "u", "u * u"]))
def q_trend_poly2(spark, sf_dir):
    return tidy(long(designed(panel(spark, sf_dir), config(TrendConfig("linear", degree=2)))[0], "x_tr"))


@query(_basis(["u", "u * u"]))
def q_trend_tree(spark, sf_dir):
    return tidy(long(designed(panel(spark, sf_dir), config(TrendConfig("tree")))[0], "x_tr"))


@query(_basis(["1", "u"]))
def q_trend_drift(spark, sf_dir):
    return tidy(long(designed(panel(spark, sf_dir), config(TrendConfig("tvp")))[0], "x_tr"))


KNOTS, DEGREE = 10, 3
_KNOT = f"""k AS (SELECT unique_id, i AS pos, least(greatest(i - {DEGREE}, 0), {KNOTS - 1}) / {KNOTS - 1}::DOUBLE AS val
  FROM c, range({KNOTS + 2 * DEGREE}) r(i))"""


@query(sql(f"{PANEL}, {SCALED}, {_KNOT}, x AS (SELECT * FROM k)", "unique_id", "pos", "val"))
def q_knots(spark, sf_dir):
    return tidy(long(designs.feature_state(panel(spark, sf_dir), config(TrendConfig("spline"))), "knots", "unique_id"))


def _cox_de_boor() -> str:
    total = KNOTS + 2 * DEGREE
    out = [f"""b0 AS (SELECT z.unique_id, t, u, a.pos AS i, CASE WHEN (u >= a.val AND u < b.val) OR (u = 1 AND a.val < b.val AND b.val = 1) THEN 1e0 ELSE 0e0 END AS v
  FROM z JOIN k a USING (unique_id) JOIN k b ON b.unique_id = z.unique_id AND b.pos = a.pos + 1)"""]
    for d in range(1, DEGREE + 1):
        out.append(f"""b{d} AS (SELECT p.unique_id, p.t, p.u, p.i, coalesce((p.u - k0.val) / nullif(kd.val - k0.val, 0), 0) * p.v
    + coalesce((ke.val - p.u) / nullif(ke.val - k1.val, 0), 0) * q.v AS v
  FROM b{d - 1} p JOIN b{d - 1} q ON q.unique_id = p.unique_id AND q.t = p.t AND q.i = p.i + 1
  JOIN k k0 ON k0.unique_id = p.unique_id AND k0.pos = p.i JOIN k kd ON kd.unique_id = p.unique_id AND kd.pos = p.i + {d}
  JOIN k k1 ON k1.unique_id = p.unique_id AND k1.pos = p.i + 1 JOIN k ke ON ke.unique_id = p.unique_id AND ke.pos = p.i + {d + 1}
  WHERE p.i <= {total - d - 2})""")
    out.append(f"x AS (SELECT unique_id, t, 0 AS pos, 1e0 AS val FROM z UNION ALL SELECT unique_id, t, 1, u FROM z UNION ALL SELECT unique_id, t, i + 1, v FROM b{DEGREE} WHERE i >= 1)")
    return ", ".join(out)


@query(sql(f"{MONTHLY}, {SCALED}, {_KNOT}, {_cox_de_boor()}", "unique_id", "t pos", "val"))
def q_spline_basis(spark, sf_dir):
    return tidy(long(designed(monthly(spark, sf_dir), config(TrendConfig("spline")))[0], "x_tr"))


def waves(*periods: tuple[float, int]) -> list[str]:
    return [f"round({f}(t * {2 * 3.141592653589793 * k / p!r}), 12)" for p, h in periods for k in range(1, h + 1) for f in ("sin", "cos")]


def seasons(*periods: tuple[float, int], centred: bool = False, calendar: Sequence[str] = ()) -> SeasonalConfig:
    return SeasonalConfig(tuple(SeasonalPeriod(*p) for p in periods), tuple(calendar), centred)


@query(_basis(waves((12, 3))))
def q_fourier_12_3(spark, sf_dir):
    return tidy(long(designed(panel(spark, sf_dir), config(seasonal=seasons((12, 3))))[0], "x_se"))


@query(_basis(waves((24, 2), (168, 3), (30.5, 1)), HOURLY))
def q_fourier_multi(spark, sf_dir):
    return tidy(long(designed(hourly(spark, sf_dir), config(seasonal=seasons((24, 2), (168, 3), (30.5, 1))))[0], "x_se"))


_CENTRED = f"""{SCALED}, {unpivoted(waves((12, 2)), source='(SELECT * FROM z WHERE t >= 2)').replace('x AS', 'w AS', 1)},
a AS (SELECT unique_id, pos, avg(val) AS m FROM w GROUP BY 1, 2)"""


@query(sql(f"{PANEL}, {_CENTRED}, x AS (SELECT unique_id, t, pos, val - m AS val FROM w JOIN a USING (unique_id, pos))", "unique_id", "t pos", "val"))
def q_seasonal_centred(spark, sf_dir):
    cfg = config(seasonal=seasons((12, 2), centred=True), lags=(1, 2))
    return tidy(long(designed(panel(spark, sf_dir), cfg)[0], "x_se"))


_FIELDS = {"month": "month(ds)", "dayofweek": "isodow(ds) - 1", "hour": "hour(ds)", "quarter": "quarter(ds)", "dayofyear": "dayofyear(ds)", "week": "weekofyear(ds)"}


@query(sql(f"{HOURLY}, x AS (SELECT t, {', '.join(f'{v} AS f_{k}' for k, v in _FIELDS.items())} FROM s)", "", "t " + " ".join(f"f_{k}" for k in _FIELDS)))
def q_calendar_fields(spark, sf_dir):
    return tidy(hourly(spark, sf_dir).select("t", *(bases.CALENDAR[c](F.col("ds")).alias(f"f_{c}") for c in CALENDAR_FIELDS)))


_LEVELS = """l AS (SELECT lev, row_number() OVER (ORDER BY lev) - 1 AS pos, count(*) OVER () AS many FROM (SELECT DISTINCT isodow(ds) - 1 AS lev FROM s WHERE t >= 24))"""


@query(sql(f"{HOURLY}, {_LEVELS}, x AS (SELECT t, pos, (isodow(ds) - 1 = lev)::INT::DOUBLE AS val FROM s, l WHERE t >= 24 AND pos < many - 1)", "", "t pos", "val"))
def q_calendar_onehot(spark, sf_dir):
    cfg = config(seasonal=seasons(calendar=["dayofweek"]), lags=(24,))
    return tidy(long(designed(hourly(spark, sf_dir), cfg)[0], "x_se", "t"))


@query(sql(f"""{MONTHLY}, l AS (SELECT lev, row_number() OVER (ORDER BY lev) - 1 AS pos, count(*) OVER () AS many FROM (SELECT DISTINCT month(ds) AS lev FROM s WHERE month(ds) <= 6)),
x AS (SELECT t, pos, (month(ds) = lev)::INT::DOUBLE AS val FROM s, l WHERE pos < many - 1)""", "", "t pos", "val"))  # fmt: skip
def q_unseen_calendar_level(spark, sf_dir):
    """Levels learned from the first half of each year; the other months are all zeros."""
    rows, cfg = monthly(spark, sf_dir), config(seasonal=seasons(calendar=["month"]))
    state = designs.feature_state(rows.where(F.month("ds") <= 6), cfg)
    return tidy(long(designs.design(rows, state, cfg), "x_se", "t"))


def lagged(*lags: int, base: str = "s") -> str:
    return f"g AS (SELECT *, {', '.join(f'lag(y, {k}) OVER (PARTITION BY unique_id ORDER BY t) AS y_lag{k}' for k in lags)} FROM {base})"


@query(sql(f"{PANEL}, {lagged(1, 2, 12)}, {unpivoted(['y_lag1', 'y_lag2', 'y_lag12'], source='(SELECT * FROM g WHERE t >= 12)')}", "unique_id", "t pos", "val", digits=4))
def q_ar_lags(spark, sf_dir):
    return tidy(long(designed(panel(spark, sf_dir), config(lags=(1, 2, 12)))[0], "x_ge"), 4)


@query(sql(f"{PANEL}, x AS (SELECT unique_id, count(*) AS n_rows, min(t) AS first_t FROM s WHERE t >= 3 GROUP BY 1)", "unique_id", "n_rows first_t"))
def q_lag_trim(spark, sf_dir):
    return tidy(designed(panel(spark, sf_dir), config(lags=(3, 1)))[0].groupBy("unique_id").agg(F.count("*").alias("n_rows"), F.min("t").alias("first_t")))


@query(sql(f"{MONTHLY}, {lagged(1)}, {unpivoted(['y_lag1', 'n_orders'], source='(SELECT * FROM g WHERE t >= 1)')}", "unique_id", "t pos", "val", digits=4))
def q_exog_join(spark, sf_dir):
    return tidy(long(designed(monthly(spark, sf_dir), config(lags=(1,), exog=("n_orders",)))[0], "x_ge"), 4)


@query(sql(f"""{PANEL}, {lagged(1)},
c AS (SELECT unique_id, count(*) + 1 AS n, avg(y) AS y_mean, stddev_pop(y) AS y_std FROM g WHERE t >= 1 GROUP BY 1),
x AS (SELECT unique_id, t, (y - y_mean) / y_std AS z, t / (n - 1)::DOUBLE AS u, sin(t * {2 * 3.141592653589793 / 12!r}) AS s1, cos(t * {2 * 3.141592653589793 / 12!r}) AS c1, y_lag1 FROM g JOIN c USING (unique_id) WHERE t >= 1)""",
    "unique_id", "t", "z u s1 c1 y_lag1", digits=4))
def q_design_full(spark, sf_dir):
    d = designed(panel(spark, sf_dir), config(seasonal=seasons((12, 1)), lags=(1,)))[0]
    return tidy(d.select("unique_id", "t", "z", F.col("x_tr")[1].alias("u"), F.col("x_se")[0].alias("s1"), F.col("x_se")[1].alias("c1"), F.col("x_ge")[0].alias("y_lag1")), 4)


def listed(block: str, names: Sequence[str], penalised: str = "false") -> str:
    """A SELECT of the features of a block by their position."""
    values = ", ".join(f"'{n}'" for n in names)
    return f"SELECT 'orders' AS unique_id, '{block}' AS block, pos, [{values}][pos + 1] AS name, {penalised} AS penalised FROM range({len(names)}) r(pos)"


@query(sql(f"""{MONTHLY}, l AS (SELECT lev, row_number() OVER (ORDER BY lev) AS k, count(*) OVER () AS many FROM (SELECT DISTINCT quarter(ds) AS lev FROM s WHERE t >= 2)),
x AS ({listed("trend", ["trend_1", "trend_t", *(f"trend_spl_{k}" for k in range(1, 12))], "pos >= 2")} UNION ALL {listed("seasonal", ["sin_p12_k1", "cos_p12_k1", "sin_p12_k2", "cos_p12_k2"])}
UNION ALL SELECT 'orders', 'seasonal', 3 + k, 'quarter_' || lev, false FROM l WHERE k < many UNION ALL {listed("generic", ["y_lag1", "y_lag2", "x_n_orders"])})""", "unique_id block name penalised", "pos"))  # fmt: skip
def q_feature_names(spark, sf_dir):
    cfg = config(TrendConfig("spline"), seasons((12, 2), calendar=["quarter"]), (1, 2), ("n_orders",))
    return tidy(designs.feature_names(designs.feature_state(monthly(spark, sf_dir), cfg), cfg))


H = 12
_FUTURE = f"f AS (SELECT unique_id, n, n - 1 AS last, y_mean, y_std, unnest(range({H})) AS h FROM c)"


@query(sql(f"{PANEL}, {SCALED}, {_FUTURE}, x AS (SELECT unique_id, h, n + h AS t, (n + h) / (n - 1)::DOUBLE AS u FROM f)", "unique_id", "h t", "u"))
def q_future_trend(spark, sf_dir):
    cfg = config()
    state = designs.feature_state(panel(spark, sf_dir), cfg)
    return tidy(designs.future_design(state, cfg, H).select("unique_id", "h", "t", F.col("x_tr")[1].alias("u")))


@query(sql(f"{PANEL}, {_CENTRED}, {_FUTURE}, v AS (SELECT unique_id, h, n + h AS t FROM f), {unpivoted(waves((12, 2)), 'unique_id, h, t', 'v').replace('x AS', 'q AS', 1)}, x AS (SELECT unique_id, h, pos, val - m AS val FROM q JOIN a USING (unique_id, pos))", "unique_id", "h pos", "val"))
def q_future_seasonal(spark, sf_dir):
    cfg = config(seasonal=seasons((12, 2), centred=True), lags=(1, 2))
    state = designs.feature_state(panel(spark, sf_dir), cfg)
    return tidy(long(designs.future_design(state, cfg, H), "x_se", "unique_id", "h"))


@query(sql(f"{MONTHLY}, x AS (SELECT unique_id, h, max(ds) + to_months((h + 1)::INT) AS ds FROM s, range({H}) r(h) GROUP BY 1, 2)", "unique_id", "h", "", "ds"))
def q_future_times(spark, sf_dir):
    rows = monthly(spark, sf_dir)
    cfg = config()
    return tidy(designs.future_times(designs.feature_state(rows, cfg), H, sources.frequency(rows)).select("unique_id", "h", "ds"))


@query(sql(f"{PANEL}, x AS (SELECT unique_id, max(t) + 1 AS t, arg_max(y, t) AS y_lag1, max(CASE WHEN t = n - 12 THEN y END) AS y_lag12 FROM (SELECT *, count(*) OVER (PARTITION BY unique_id) AS n FROM s) GROUP BY 1)", "unique_id", "t", "y_lag1 y_lag12", digits=4))
def q_future_row(spark, sf_dir):
    rows, cfg = panel(spark, sf_dir), config(lags=(1, 12))
    row = designs.future_row(designs.feature_state(rows, cfg), rows, cfg, 0)
    return tidy(row.select("unique_id", "t", F.col("x_ge")[0].alias("y_lag1"), F.col("x_ge")[1].alias("y_lag12")), 4)


# ---- sums and closed forms ------------------------------------------------------------------------------------------

_SUMS = """g AS (SELECT unique_id, count(*) AS n_rows, count(*)::DOUBLE AS g00, sum(u) AS g01, sum(u * u) AS g11, sum(z) AS c0, sum(u * z) AS c1, sum(z * z) AS zz FROM z GROUP BY 1)"""
_RIDGE = """b AS (SELECT unique_id, ((g11 + 0.01) * c0 - g01 * c1) / ((g00 + 0.01) * (g11 + 0.01) - g01 * g01) AS b0,
  ((g00 + 0.01) * c1 - g01 * c0) / ((g00 + 0.01) * (g11 + 0.01) - g01 * g01) AS b1 FROM g)"""


def moments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d, state = designed(panel(spark, sf_dir), config())
    return fit.trend_moments(d, 2), state


@query(sql(f"{PANEL}, {SCALED}, {_SUMS}, x AS (SELECT * FROM g)", "unique_id", "n_rows", "g00 g01 g11 c0 c1 zz"))
def q_gram(spark, sf_dir):
    g, c = F.col("gram"), F.col("cross")
    m = moments(spark, sf_dir)[0]
    return tidy(m.select("unique_id", F.col("n").alias("n_rows"), g[0].alias("g00"), g[1].alias("g01"), g[2].alias("g11"), c[0].alias("c0"), c[1].alias("c1"), "zz"))


@query(sql(f"{PANEL}, {SCALED}, x AS (SELECT unique_id, greatest(var_pop(z) - covar_pop(u, z) * covar_pop(u, z) / var_pop(u), 1e-3) AS sigma2 FROM z GROUP BY 1)", "unique_id", "", "sigma2"))
def q_ols_sigma2(spark, sf_dir):
    return tidy(fit.least_squares_variance(moments(spark, sf_dir)[0]))


@query(sql(f"{PANEL}, {SCALED}, {_SUMS}, {_RIDGE}, x AS (SELECT * FROM b)", "unique_id", "", "b0 b1"))
def q_ridge_posterior_mean(spark, sf_dir):
    return tidy(fit.ridge_line(moments(spark, sf_dir)[0]))


@query(sql(f"{PANEL}, {SCALED}, {_SUMS}, {_RIDGE}, {_FUTURE}, x AS (SELECT unique_id, h, n + h AS t, y_mean + y_std * (b0 + b1 * (n + h) / (n - 1)::DOUBLE) AS mean FROM f JOIN b USING (unique_id))", "unique_id", "h t", "mean", digits=2))
def q_forecast_mean(spark, sf_dir):
    """The flagship: orders to a monthly panel, its lines' posterior means and their forecasts, all in the JVM."""
    m, state = moments(spark, sf_dir)
    return tidy(forecast.trend_mean(fit.ridge_line(m), state, designs.future_design(state, config(), H)), 2)


_EVIDENCE = "x AS (SELECT event_type, value <= 50 AS goes_left, 0.5 * ln(4 / (4 + count(*) / 2e0)) + 0.5 * power(sum((value - 50) / 25 / 2e0), 2) / (4 + count(*) / 2e0) AS lml FROM events GROUP BY 1, 2)"


@query(sql(_EVIDENCE, "event_type goes_left", "", "lml"))
def q_leaf_marginal_split(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_type", (F.col("value") <= 50).alias("goes_left"), ((F.col("value") - 50) / 25).alias("r"))
    return tidy(fit.leaf_evidence(rows, ["event_type", "goes_left"], 0.25, 2.0))


# ---- trees ----------------------------------------------------------------------------------------------------------


def node(feat: Column | int, thresh: Column | float, left: int, right: int, value: Column | float) -> Column:
    c = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    return F.struct(c(feat, "int").alias("feat"), c(thresh, "double").alias("thresh"), c(left, "int").alias("left"), c(right, "int").alias("right"), c(value, "double").alias("value"))


def leaf(value: Column | float) -> Column:
    return node(-1, 0.0, -1, -1, value)


def stump(feat: int, thresh: Column | float, left: Column | float, right: Column | float) -> Column:
    return F.array(node(feat, thresh, 1, 2, 0.0), leaf(left), leaf(right))


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", bases.doubles(F.col("p_size"), F.col("p_retailprice")).alias("x"))


@query(sql("x AS (SELECT p_partkey, CASE WHEN p_size <= 25 THEN -1.5 ELSE 2.5 END::DOUBLE AS value FROM part)", "", "p_partkey", "value"))
def q_stump_predict(spark, sf_dir):
    return tidy(part_rows(spark, sf_dir).select("p_partkey", bases.tree_value(stump(0, 25.0, -1.5, 2.5), F.col("x")).alias("value")))


@query(sql("""x AS (SELECT p_partkey, CASE WHEN p_size <= 25 THEN CASE WHEN p_retailprice <= 1200 THEN 0.25 ELSE 0.75 END ELSE CASE WHEN p_size <= 40 THEN -0.5 ELSE 1 END END::DOUBLE
  + CASE WHEN p_retailprice <= 1500 THEN 0.125 ELSE -0.125 END::DOUBLE AS value FROM part)""", "", "p_partkey", "value"))  # fmt: skip
def q_tree_predict(spark, sf_dir):
    deep = F.array(node(0, 25.0, 1, 2, 0.0), node(1, 1200.0, 3, 4, 0.0), node(0, 40.0, 5, 6, 0.0), leaf(0.25), leaf(0.75), leaf(-0.5), leaf(1.0))
    trees = F.array(deep, stump(1, 1500.0, 0.125, -0.125))
    return tidy(part_rows(spark, sf_dir).select("p_partkey", bases.forest_value(trees, F.col("x")).alias("value")))


def event_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up posterior that SQL can repeat: each event is a draw whose forest is one stump, or a leaf alone."""
    e = _read(spark, sf_dir, "events")
    thresh, feat = F.col("value") / 100, F.col("event_id") % 2
    tree = F.when(F.col("event_id") % 3 == 0, F.array(leaf(0.5))).when(feat == 0, stump(0, thresh, -1.0, 1.0)).otherwise(stump(1, thresh, 2.0, -2.0))
    return e.select(F.col("event_type").alias("unique_id"), F.lit(0).alias("chain"), F.col("event_id").alias("draw"), F.array(tree).alias("generic_trees"))


@query(sql("x AS (SELECT event_type AS unique_id, event_id AS draw, pos, CASE WHEN event_id % 3 <> 0 AND event_id % 2 = pos THEN 1 ELSE 0 END AS n FROM events, range(2) r(pos))", "unique_id", "draw pos n"))
def q_split_counts(spark, sf_dir):
    p = event_posterior(spark, sf_dir).withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1))))
    return tidy(p.select("unique_id", "draw", "pos", bases.split_count(F.col("generic_trees"), F.col("pos")).alias("n")))


_USED = "u AS (SELECT event_type AS unique_id, pos, CASE WHEN event_id % 3 <> 0 AND event_id % 2 = pos THEN 1e0 ELSE 0e0 END AS n FROM events, range(2) r(pos))"


@query(sql(f"{_USED}, x AS (SELECT unique_id, 'f' || pos AS feature, avg(n) AS mean, quantile_cont(n, 0.05) AS lower, quantile_cont(n, 0.95) AS upper, avg((n > 0)::INT) AS inclusion_prob FROM u GROUP BY 1, 2)", "unique_id feature", "", "mean lower upper inclusion_prob"))
def q_split_importance(spark, sf_dir):
    p = event_posterior(spark, sf_dir)
    names = p.select("unique_id").distinct().select("unique_id", F.lit("generic").alias("block"), F.posexplode(F.array(F.lit("f0"), F.lit("f1"))).alias("pos", "name"))
    return tidy(interpret.split_importance(p, names, "generic"))


_DEPENDENCE = """r AS (SELECT event_type AS unique_id, hour(ts) AS k, avg(value) / 100 AS a, min(value) / 100 AS b FROM events GROUP BY 1, 2),
p AS (SELECT event_type AS unique_id, event_id, g.g, CASE WHEN event_id % 3 = 0 THEN 0.5 WHEN event_id % 2 = 0 THEN CASE WHEN g.g <= value / 100 THEN -1 ELSE 1 END ELSE NULL END::DOUBLE AS flat, value / 100 AS thresh
  FROM events, (VALUES (0.2), (0.5), (0.8)) g(g)),
d AS (SELECT p.unique_id, event_id, g, coalesce(flat, avg(CASE WHEN b <= thresh THEN 2e0 ELSE -2e0 END)) * 3 AS v FROM p JOIN r USING (unique_id) GROUP BY p.unique_id, event_id, g, flat, thresh),
x AS (SELECT unique_id, g::DOUBLE AS x, avg(v) AS mean, quantile_cont(v, 0.05) AS lower, quantile_cont(v, 0.95) AS upper FROM d GROUP BY 1, 2)"""


@query(sql(_DEPENDENCE, "unique_id", "", "x mean lower upper").replace("FROM x", "FROM x AS q").replace("round(x +", "round(q.x +"))
def q_partial_dependence(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("unique_id"), F.hour("ts").alias("k")).agg((F.avg("value") / 100).alias("a"), (F.min("value") / 100).alias("b"))
    design = rows.select("unique_id", F.array("a", "b").alias("x_ge"))
    state = rows.select("unique_id").distinct().withColumn("y_std", F.lit(3.0))
    return tidy(interpret.partial_dependence(event_posterior(spark, sf_dir), design, state, "generic", 0, [0.2, 0.5, 0.8]))


# ---- draws, bands and scores ----------------------------------------------------------------------------------------
# Draws that SQL can repeat: the events of an hour of the day are the samples of that step.

_DRAWS = """e AS (SELECT event_type AS unique_id, 0 AS chain, event_id AS draw, hour(ts) AS h, hour(ts) + 100 AS t, value AS sample,
  value / 2 AS trend, value % 7 AS seasonal, -value / 10 AS generic FROM events)"""


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("unique_id"), F.lit(0).alias("chain"), F.col("event_id").alias("draw"), F.hour("ts").alias("h"), (F.hour("ts") + 100).alias("t"), v.alias("sample"), (v / 2).alias("trend"), (v % 7).alias("seasonal"), (-v / 10).alias("generic"))


def band(value: str, low: float = 0.05, high: float = 0.95) -> str:
    return f"avg({value}) AS mean, quantile_cont({value}, {low}) AS lower, quantile_cont({value}, {high}) AS upper"


@query(sql(f"{_DRAWS}, x AS (SELECT unique_id, h, t, avg(sample) AS mean, quantile_cont(sample, 0.5) AS median FROM e GROUP BY ALL)", "unique_id", "h t", "mean median"))
def q_forecast_point(spark, sf_dir):
    d = draws(spark, sf_dir)
    return tidy(forecast.mean(d).join(forecast.median(d), ["unique_id", "h", "t"]))


@query(sql(f"{_DRAWS}, x AS (SELECT unique_id, h, t, {band('sample', 0.1, 0.9)} FROM e GROUP BY ALL)", "unique_id", "h t", "lower upper"))
def q_forecast_interval(spark, sf_dir):
    return tidy(forecast.interval(draws(spark, sf_dir), 0.8))


_LONG = "l AS (" + " UNION ALL ".join(f"SELECT *, '{c}' AS component, {c} AS value FROM e" for c in ("trend", "seasonal", "generic")) + ")"


@query(sql(f"{_DRAWS}, {_LONG}, x AS (SELECT unique_id, component, h, t, {band('value')} FROM l GROUP BY ALL)", "unique_id component", "h t", "mean lower upper"))
def q_component_bands(spark, sf_dir):
    return tidy(forecast.component_bands(draws(spark, sf_dir)))


@query(sql(f"{_DRAWS}, x AS (SELECT unique_id, h, t, avg(sample) AS model, quantile_cont(sample, 0.1) AS lo80, quantile_cont(sample, 0.9) AS hi80, quantile_cont(sample, 0.05) AS lo90, quantile_cont(sample, 0.95) AS hi90 FROM e GROUP BY ALL)", "unique_id", "h t", "model lo80 hi80 lo90 hi90"))
def q_forecast_wide(spark, sf_dir):
    d = draws(spark, sf_dir)
    times = d.select("unique_id", "h").distinct().withColumn("ds", F.lit(None).cast("timestamp"))
    return tidy(forecast.wide(d, times).drop("ds").toDF("unique_id", "h", "t", "model", "lo80", "hi80", "lo90", "hi90"))


@query(sql(f"""{_DRAWS}, w AS (SELECT unique_id, t, 10 + 2 * trend AS trend, 2 * seasonal AS seasonal, 2 * generic AS generic, 10 + 2 * (trend + seasonal + generic) AS fitted FROM e),
l AS ({" UNION ALL ".join(f"SELECT unique_id, t, '{c}' AS component, {c} AS value FROM w" for c in ("trend", "seasonal", "generic", "fitted"))}),
q AS (SELECT unique_id, component, t AS step, {band('value')} FROM l GROUP BY ALL), x AS (SELECT * FROM q)""", "unique_id component", "step", "mean lower upper"))  # fmt: skip
def q_decomposition(spark, sf_dir):
    d = draws(spark, sf_dir)
    state = d.select("unique_id").distinct().select("unique_id", F.lit(10.0).alias("y_mean"), F.lit(2.0).alias("y_std"))
    return tidy(interpret.decomposition(d.select("unique_id", "chain", "draw", "t", "trend", "seasonal", "generic"), state).withColumnRenamed("x", "step"))


@query(sql(f"{_DRAWS}, d AS (SELECT a.unique_id, a.h, (a.sample + a.seasonal) - a.sample AS value FROM e a JOIN e b USING (unique_id, chain, draw, h)), x AS (SELECT unique_id, h, {band('value')} FROM d GROUP BY ALL)", "unique_id", "h", "mean lower upper"))
def q_response_bands(spark, sf_dir):
    d = draws(spark, sf_dir)
    shocked = d.withColumn("sample", F.col("sample") + F.col("seasonal"))
    return tidy(interpret.bands(interpret.response(d, shocked), ("unique_id", "h")))


# Forecasts of made-up draws without noise: a line, a stump on the last value and one on a covariate, which SQL can follow.
_STEPS = f"""RECURSIVE {PANEL}, k AS (SELECT unique_id, count(*) AS n, avg(y) FILTER (t >= 1) AS m, coalesce(nullif(stddev_pop(y) FILTER (t >= 1), 0), 1) AS sd, arg_max(y, t) AS last FROM s GROUP BY 1),
p AS (SELECT unique_id, d, c, n, m, sd, -1 AS h, last AS v, 0e0 AS trend, 0e0 AS generic FROM k, range(3) r(d), range(2) q(c)
  UNION ALL SELECT unique_id, d, c, n, m, sd, h, m + sd * (line + g) AS v, m + sd * line AS trend, sd * g AS generic
  FROM (SELECT * EXCLUDE (h), h + 1 AS h, 0.1 + 0.05 * d + 0.2 * (n + h + 1) / (n - 1)::DOUBLE AS line, CASE WHEN v <= m THEN -0.3 ELSE 0.4 END + 0.2 * c AS g FROM p WHERE h < {H - 1})),
f AS (SELECT * FROM p WHERE h >= 0)"""


def steps_ahead(spark: SparkSession, sf_dir: str, shock: float) -> DataFrame:
    """The samples of simulate() for those draws, with the covariate at shock."""
    cfg = config(lags=(1,), exog=("shock",))
    rows = panel(spark, sf_dir).withColumn("x_shock", F.lit(0.0))
    state = designs.feature_state(rows, cfg)
    drawn = state.withColumn("draw", F.explode(F.array(*map(F.lit, range(3)))))
    fixed = drawn.select(
        "unique_id", F.lit(0).alias("chain"), "draw", F.array(0.1 + 0.05 * F.col("draw"), F.lit(0.2)).alias("beta"), F.lit(0.0).alias("sigma2"),
        F.array(stump(0, F.col("y_mean"), -0.3, 0.4), stump(1, 0.5, 0.0, 0.2)).alias("generic_trees"), F.lit(None).cast("string").alias("error"),
    )
    future = designs.future_design(state, cfg, H)
    return forecast.simulate(fixed, state, future, rows, cfg, H, future.select("unique_id", "h", F.lit(shock).alias("shock")))


@query(sql(f"{_STEPS}, x AS (SELECT unique_id, d AS draw, h, n + h AS t, v AS sample, trend, generic FROM f WHERE c = 0)", "unique_id", "draw h t", "sample trend generic", digits=2))
def q_forecast_recursion(spark, sf_dir):
    return tidy(steps_ahead(spark, sf_dir, 0.0).drop("chain", "seasonal"), 2)


@query(sql(f"{_STEPS}, d AS (SELECT a.unique_id, a.h, b.v - a.v AS value FROM f a JOIN f b USING (unique_id, d, h) WHERE a.c = 0 AND b.c = 1), x AS (SELECT unique_id, h, {band('value')} FROM d GROUP BY ALL)", "unique_id", "h", "mean lower upper", digits=2))
def q_response_recursion(spark, sf_dir):
    """The response to a shock whose noise cancels, along the whole recursion."""
    return tidy(interpret.bands(interpret.response(steps_ahead(spark, sf_dir, 0.0), steps_ahead(spark, sf_dir, 1.0)), ("unique_id", "h")), 2)


_SAMPLES = """a AS (SELECT hour(ts) AS h, avg(value) AS actual FROM events GROUP BY 1),
s AS (SELECT event_type AS unique_id, hour(ts) AS h, actual, value AS sample FROM events JOIN a ON a.h = hour(ts)),
p AS (SELECT unique_id, h, any_value(actual) AS actual, avg(sample) AS mean FROM s GROUP BY 1, 2),
i AS (SELECT unique_id, h, any_value(actual) AS actual, quantile_cont(sample, 0.05) AS lower, quantile_cont(sample, 0.95) AS upper FROM s GROUP BY 1, 2),
y AS (SELECT event_type AS unique_id, date_trunc('day', ts) AS t, avg(value) AS y FROM events GROUP BY 1, 2),
k AS (SELECT unique_id, greatest(avg(abs(d)), 1e-8) AS scale FROM (SELECT unique_id, y - lag(y) OVER (PARTITION BY unique_id ORDER BY t) AS d FROM y) GROUP BY 1),
m_rmse AS (SELECT unique_id, sqrt(avg(power(actual - mean, 2))) AS rmse FROM p GROUP BY 1),
m_smape AS (SELECT unique_id, avg(200 * abs(actual - mean) / greatest(abs(actual) + abs(mean), 1e-8)) AS smape FROM p GROUP BY 1),
m_mase AS (SELECT unique_id, avg(abs(actual - mean)) / any_value(scale) AS mase FROM p JOIN k USING (unique_id) GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY unique_id, h ORDER BY sample) AS i, count(*) OVER (PARTITION BY unique_id, h) AS n FROM s),
m_crps AS (SELECT unique_id, avg(c) AS crps FROM (SELECT unique_id, h, avg(abs(sample - actual)) - sum((2 * i - n - 1) * sample) / power(any_value(n), 2) AS c FROM r GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT unique_id, h, any_value(actual) AS actual, quantile_cont(sample, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS q FROM s GROUP BY 1, 2),
m_pinball AS (SELECT unique_id, avg(greatest(j / 20e0 * (actual - q[j]), (j / 20e0 - 1) * (actual - q[j]))) AS pinball FROM q, range(1, 20) w(j) GROUP BY 1),
m_coverage AS (SELECT unique_id, avg((actual >= lower AND actual <= upper)::INT) AS coverage FROM i GROUP BY 1),
m_interval_score AS (SELECT unique_id, avg(upper - lower + 20 * CASE WHEN actual < lower THEN lower - actual WHEN actual > upper THEN actual - upper ELSE 0 END) AS interval_score FROM i GROUP BY 1)"""
_BY = ["unique_id"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("event_type", "value", F.hour("ts").alias("h"))
    actual = events.groupBy("h").agg(F.avg("value").alias("actual"))
    return events.join(F.broadcast(actual), "h").select(F.col("event_type").alias("unique_id"), "h", "actual", F.col("value").alias("sample"))  # 24 rows


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("unique_id"), F.date_trunc("day", "ts").alias("t")).agg(F.avg("value").alias("y"))


def _score(name: str, make: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(make(samples(spark, sf_dir), daily(spark, sf_dir)))

    run.__name__ = f"q_{name}"
    query(sql(f"{_SAMPLES}, x AS (SELECT * FROM m_{name})", "unique_id", "", name))(run)


_score("rmse", lambda s, y: metrics.rmse(metrics.point(s, _BY), _BY))
_score("smape", lambda s, y: metrics.smape(metrics.point(s, _BY), _BY))
_score("mase", lambda s, y: metrics.mase(metrics.point(s, _BY), y, _BY))
_score("crps", lambda s, y: metrics.crps(s, _BY))
_score("pinball", lambda s, y: metrics.pinball(s, _BY))
_score("coverage", lambda s, y: metrics.coverage(metrics.intervals(s, _BY), _BY))
_score("interval_score", lambda s, y: metrics.interval_score(metrics.intervals(s, _BY), _BY))
_SCORES = "rmse smape mase crps pinball coverage interval_score"


@query(sql(f"{_SAMPLES}, x AS (SELECT * FROM {' JOIN '.join(f'm_{m}' + (' USING (unique_id)' if k else '') for k, m in enumerate(_SCORES.split()))})", "unique_id", "", _SCORES))
def q_metric_battery(spark, sf_dir):
    return tidy(metrics.evaluate(samples(spark, sf_dir), daily(spark, sf_dir), _BY))


@query(sql(f"""{_DRAWS}, {_LONG}, b AS (SELECT unique_id, component, t, {band('value')} FROM l GROUP BY ALL),
c AS (SELECT hour(ts) + 100 AS t, avg(value) / 2 AS trend, 3e0 AS seasonal, -avg(value) / 10 AS generic FROM events GROUP BY 1),
v AS ({" UNION ALL ".join(f"SELECT t, '{c}' AS component, {c} AS actual FROM c" for c in ("trend", "seasonal", "generic"))}),
x AS (SELECT unique_id, component, sqrt(avg(power(mean - actual, 2))) AS rmse, avg((actual >= lower AND actual <= upper)::INT) AS coverage FROM b JOIN v USING (component, t) GROUP BY 1, 2)""",
    "unique_id component", "", "rmse coverage"))
def q_component_fidelity(spark, sf_dir):
    d = draws(spark, sf_dir)
    truth = d.groupBy("t").agg((F.avg("sample") / 2).alias("trend"), F.lit(3.0).alias("seasonal"), (-F.avg("sample") / 10).alias("generic"))
    truth = d.select("unique_id", "t").distinct().join(truth, "t")
    return tidy(metrics.component_fidelity(d, truth))


@query(sql(f"{_SAMPLES}, x AS (SELECT left(unique_id, 1) AS mode, avg(rmse) AS rmse, avg(crps) AS crps FROM m_rmse JOIN m_crps USING (unique_id) GROUP BY 1)", "mode", "", "rmse crps"))
def q_trial_summary(spark, sf_dir):
    s = samples(spark, sf_dir)
    each = metrics.rmse(metrics.point(s, _BY), _BY).join(metrics.crps(s, _BY), _BY).withColumn("mode", F.substring("unique_id", 1, 1))
    return tidy(metrics.trial_summary(each, ["mode"], ["rmse", "crps"]))


# ---- chains ---------------------------------------------------------------------------------------------------------

_CHAINS = "e AS (SELECT event_id % 4 AS chain, event_id // 4 AS draw, value FROM events), d AS (SELECT *, value - avg(value) OVER (PARTITION BY chain) AS d, var_pop(value) OVER (PARTITION BY chain) AS v, row_number() OVER (PARTITION BY chain ORDER BY draw) AS i, count(*) OVER (PARTITION BY chain) AS n FROM e)"


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("chain"), F.floor(F.col("event_id") / 4).alias("draw"), "value")


@query(sql(f"{_CHAINS}, x AS (SELECT a.chain, k AS lag, avg(a.d * b.d) / any_value(a.v) AS rho FROM range(1, 6) r(k) JOIN d a ON true JOIN d b ON b.chain = a.chain AND b.i = a.i + k GROUP BY 1, 2)", "", "chain lag", "rho"))
def q_autocorr(spark, sf_dir):
    return tidy(diagnostics.autocorrelation(chains(spark, sf_dir), range(1, 6)))


@query(sql(f"""{_CHAINS}, r AS (SELECT a.chain, k, any_value(a.n) AS n, avg(a.d * b.d) / any_value(a.v) AS rho FROM range(1, 100) r(k) JOIN d a ON k < least(a.n - 1, 100) JOIN d b ON b.chain = a.chain AND b.i = a.i + k GROUP BY 1, 2),
p AS (SELECT chain, any_value(n) AS n, (k - 1) // 2 AS j, sum(rho) AS s FROM r GROUP BY 1, 3 HAVING count(*) = 2),
o AS (SELECT *, max((s < 0)::INT) OVER (PARTITION BY chain ORDER BY j) AS gone FROM p),
x AS (SELECT chain, greatest(1, least(any_value(n), any_value(n) / (1 + 2 * coalesce(sum(CASE WHEN gone = 0 THEN s END), 0))))::DOUBLE AS ess FROM o GROUP BY 1)""", "", "chain", "ess", digits=4))  # fmt: skip
def q_ess(spark, sf_dir):
    return tidy(diagnostics.effective_size(chains(spark, sf_dir)), 4)


@query(sql("""e AS (SELECT event_id % 4 AS chain, value FROM events), c AS (SELECT chain, avg(value) AS m, var_samp(value) AS v, count(*) AS s FROM e GROUP BY 1),
x AS (SELECT sqrt(((any_value(s) - 1) / any_value(s)::DOUBLE * avg(v) + var_samp(m)) / avg(v)) AS rhat FROM c)""", "", "", "rhat"))  # fmt: skip
def q_rhat(spark, sf_dir):
    return tidy(diagnostics.rhat(chains(spark, sf_dir)))


@query(sql(f"{_CHAINS}, x AS (SELECT chain, -2 / sqrt(count(*)) AS lower, 2 / sqrt(count(*)) AS upper FROM e GROUP BY 1)", "", "chain", "lower upper"))
def q_acf_band(spark, sf_dir):
    return tidy(diagnostics.acf_band(chains(spark, sf_dir)))


# ---- the sampler: stochastic, so without SQL --------------------------------------------------------------------------


@query()
def fit_trend_panel(spark, sf_dir):
    """Coefficient and noise summaries of a spline trend for every nation, from sums alone."""
    cfg = ModelConfig(TrendConfig("spline"), generic=GenericConfig(()), mcmc=MCMCConfig(0, 200, 500, chains=2))
    d, _ = designed(panel(spark, sf_dir), cfg)
    p = fit.moments_posterior(fit.trend_moments(d, len(cfg.trend.names())), cfg)
    return p.groupBy("unique_id", "chain").agg(F.count("*").alias("draws"), F.avg("sigma2").alias("sigma2"), F.max("error").alias("error"))


#: The schedule of simulation studies, 460 sweeps.
SCHEDULE = {"num_gfr": 10, "num_burnin": 150, "num_mcmc": 300}


def model(**more: object) -> SeriesModel:
    """Three blocks: a line, a yearly season and the value before."""
    return SeriesModel(make_config(**{"trend": "linear", "periods": [(12, 2)], "lags": (1,), **SCHEDULE, **more}))


# What holds for every fit and forecast, whatever the draws.


def sound(run: artifacts.Run) -> DataFrame:
    """unique_id, chain; draws; whole: whether every draw has a value for each row in all parts; closed: whether target less
    parts is the residual in every draw; failed: chains with an error."""
    rows = run.state.select("unique_id", (F.col("n") - F.col("max_lag")).alias("n"))
    sizes = [F.size(c) == F.col("n") for c in interpret.COMPONENTS]
    return run.posterior.join(rows, "unique_id").groupBy("unique_id", "chain").agg(F.count("*").alias("draws"), F.bool_and(sizes[0] & sizes[1] & sizes[2]).alias("whole"), (F.max("gap") < 1e-7).alias("closed"), F.count("error").alias("failed"))


@query(sql(f"{PANEL}, x AS (SELECT DISTINCT unique_id, 0 AS chain, {SCHEDULE['num_mcmc']} AS draws, true AS whole, true AS closed, 0 AS failed FROM s)", "unique_id whole closed", "chain draws failed"))
def q_fit_invariants(spark, sf_dir):
    return tidy(sound(model().fit(panel(spark, sf_dir)).run))


_VARIANTS = "e AS (SELECT * FROM (VALUES ('tree'), ('linear'), ('spline'), ('tvp')) a(trend), (VALUES ('homo'), ('sv')) b(errors), range(2) c(chain))"


@query(sql(f"{_VARIANTS}, x AS (SELECT trend, errors, 'orders' AS unique_id, chain, {SCHEDULE['num_mcmc']} AS draws, true AS whole, true AS closed, 0 AS failed FROM e)", "trend errors unique_id whole closed", "chain draws failed"))
def q_variant_invariants(spark, sf_dir):
    """Every trend with every kind of noise, two chains of the studies' schedule each."""
    rows, out = monthly(spark, sf_dir).withColumnRenamed("x_n_orders", "n_orders"), None
    for trend in TREND_MODES:
        for errors in ERROR_MODES:
            fitted = model(trend=trend, errors=errors, exog=("n_orders",), chains=2).fit(rows)
            one = sound(fitted.run).select(F.lit(trend).alias("trend"), F.lit(errors).alias("errors"), "*")
            out = one if out is None else out.union(one)
    return tidy(out)


_NEXT = _STEP.replace("x AS (SELECT u.unique_id", "fq AS (SELECT u.unique_id")


@query(sql(f"{PANEL}, {_NEXT}, k AS (SELECT unique_id, max(t) AS last, max(ds) AS ds FROM s GROUP BY 1), x AS (SELECT unique_id, h, last + 1 + h AS t, ds + to_months(((h + 1) * months)::INT) AS ds, true AS nested FROM k JOIN fq USING (unique_id), range(6) r(h))", "unique_id nested", "h t", "", "ds"))
def q_forecast_order(spark, sf_dir):
    """The times of forecasts, and whether the narrower band lies within the wider one with the median between."""
    made = model().fit(panel(spark, sf_dir)).forecast_wide(6, (0, 80, 90))
    at = lambda name: F.col(f"`model-{name}`")
    nested = (at("lo-90") <= at("lo-80")) & (at("lo-80") <= at("lo-0")) & (at("hi-0") <= at("hi-80")) & (at("hi-80") <= at("hi-90"))
    return tidy(made.select("unique_id", "h", "t", "ds", nested.alias("nested")))


@query()
def fit_panel_full(spark, sf_dir):
    """The largest break of the residual identity and the mean noise of each nation's three-block fit."""
    fitted = model().fit(panel(spark, sf_dir))
    return fitted.run.posterior.groupBy("unique_id", "chain").agg(F.count("*").alias("draws"), F.max("gap").alias("gap"), F.avg("sigma2").alias("sigma2"), F.max("error").alias("error"))


@query()
def forecast_panel_full(spark, sf_dir):
    return model().fit(panel(spark, sf_dir)).forecast_wide(6)


@query()
def decomposition_monthly(spark, sf_dir):
    return model(errors="sv", trend="tvp").fit(monthly(spark, sf_dir)).decomposition()


@query()
def girf_monthly(spark, sf_dir):
    rows = monthly(spark, sf_dir)
    fitted = model(exog=("n_orders",)).fit(rows.withColumnRenamed("x_n_orders", "n_orders"))
    calm = rows.groupBy("unique_id").agg(F.avg("x_n_orders").alias("n_orders")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return fitted.girf(6, calm, calm.withColumn("n_orders", F.col("n_orders") * 1.5))


@query()
def importance_panel(spark, sf_dir):
    return model(trend="tree").fit(panel(spark, sf_dir)).split_importance("seasonal")


_PROCESSES = """g AS (SELECT kind, n, trial, t FROM (VALUES (1, 200), (2, 250), (3, 200), (4, 80), (5, 200), (6, 200)) v(kind, n), range(100) r(trial), range(250) s(t) WHERE t < n),
x AS (SELECT 'dgp' || kind || '-' || trial AS unique_id, trial, t,
  CASE kind WHEN 2 THEN 2 + 0.03 * t - 0.00015 * t * t + 0.5 * sin(2 * pi() * t / 80) WHEN 3 THEN CASE WHEN t < n // 2 THEN 1 ELSE 4 END WHEN 4 THEN 0.5 + 0.02 * t ELSE 1 + 0.03 * t END::DOUBLE AS trend,
  CASE kind WHEN 2 THEN 1.2 * sin(2 * pi() * t / 12) + 0.8 * sin(2 * pi() * t / 7) WHEN 3 THEN 1.2 * sin(2 * pi() * t / 12) WHEN 4 THEN cos(2 * pi() * t / 4) ELSE 1.5 * sin(2 * pi() * t / 12) END AS seasonal,
  0e0 AS rest FROM g)"""


@query(sql(_PROCESSES, "unique_id", "trial t", "trend seasonal rest"))
def q_synthetic_parts(spark, sf_dir):
    """The parts of synthetic series that aren't random, and what is left of y without all parts."""
    rows = synthetic.studies(spark, 100)
    return tidy(rows.select("unique_id", "trial", "t", "trend", "seasonal", (F.col("y") - F.col("trend") - F.col("seasonal") - F.col("generic")).alias("rest")))


@query()
def synthetic_trials(spark, sf_dir):
    """A hundred series of each of the six processes."""
    return synthetic.studies(spark, 100)
