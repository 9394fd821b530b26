"""Queries of the drifting trend's filter and smoother and of the volatility's mixture step, moments by recursion in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.config import TrendConfig
from loomcast.operators import scan, volatility
from loomcast.operators.gibbs import MIX_M, MIX_P, MIX_V
from loomcast.plans.queries import HOURLY, PANEL, SCALED, config, designed, hourly, panel
from loomcast.plans.registry import query, sql, tidy

STATE = "m0 m1 p00 p01 p11"


def drifting(base: str) -> str:
    """Tables d (rows with noise variance v and drift q), f (filtered moments) and b (smoothed moments)."""
    update = lambda source: f"""SELECT unique_id, t, last, q, m0 + k0 * e AS m0, m1 + k1 * e AS m1, p00 - k0 * k0 * s AS p00, p01 - k0 * k1 * s AS p01, p11 - k1 * k1 * s AS p11
  FROM (SELECT *, (p00 + u * p01) / s AS k0, (p01 + u * p11) / s AS k1, z - m0 - u * m1 AS e FROM (SELECT *, p00 + 2 * u * p01 + u * u * p11 + v AS s FROM ({source})))"""  # noqa: E731
    first = "SELECT d.*, 0e0 AS m0, 0e0 AS m1, 100 + q AS p00, 0e0 AS p01, 100 + q AS p11 FROM d WHERE t = 0"
    later = "SELECT d.*, m0, m1, p00 + d.q AS p00, p01, p11 + d.q AS p11 FROM f JOIN d ON d.unique_id = f.unique_id AND d.t = f.t + 1"
    return f"""RECURSIVE {base}, {SCALED},
d AS (SELECT unique_id, t, u, z, 0.5 + 0.1 * (t % 3) AS v, greatest(100 / n::DOUBLE, 1e-6) AS q, n - 1 AS last FROM z),
f AS ({update(first)} UNION ALL {update(later)}),
b AS (SELECT unique_id, t, m0, m1, p00, p01, p11 FROM f WHERE t = last
  UNION ALL SELECT unique_id, t, m0 + g00 * e0 + g01 * e1 AS m0, m1 + g10 * e0 + g11 * e1 AS m1, p00 + h00 * g00 + h01 * g01 AS p00, p01 + h00 * g10 + h01 * g11 AS p01, p11 + h10 * g10 + h11 * g11 AS p11
  FROM (SELECT *, g00 * d00 + g01 * d01 AS h00, g00 * d01 + g01 * d11 AS h01, g10 * d00 + g11 * d01 AS h10, g10 * d01 + g11 * d11 AS h11
    FROM (SELECT *, (p00 * w11 - p01 * p01) / w AS g00, (p01 * w00 - p00 * p01) / w AS g01, (p01 * w11 - p11 * p01) / w AS g10, (p11 * w00 - p01 * p01) / w AS g11
      FROM (SELECT f.*, f.p00 + q AS w00, f.p11 + q AS w11, (f.p00 + q) * (f.p11 + q) - f.p01 * f.p01 AS w, b.m0 - f.m0 AS e0, b.m1 - f.m1 AS e1, b.p00 - f.p00 - q AS d00, b.p01 - f.p01 AS d01, b.p11 - f.p11 - q AS d11
        FROM b JOIN f ON f.unique_id = b.unique_id AND f.t = b.t - 1))))"""


def moments(df: DataFrame) -> DataFrame:
    m, p = F.col("mean"), F.col("var")
    return tidy(df.select("unique_id", "t", m[0].alias("m0"), m[1].alias("m1"), p[0].alias("p00"), p[1].alias("p01"), p[3].alias("p11")))


def filtered(rows: DataFrame) -> DataFrame:
    d, state = designed(rows, config(TrendConfig("tvp")))
    drift = F.greatest(F.lit(100.0) / F.col("n"), F.lit(1e-6))
    seen = d.join(state.select("unique_id", "n"), "unique_id").withColumn("q", drift)
    return scan.kalman_filter(seen, ["unique_id"], ["t"], F.col("z"), F.col("x_tr"), 0.5 + 0.1 * (F.col("t") % 3), F.col("q"), 1.0, 100.0 + F.col("q"))


@query(sql(f"{drifting(HOURLY)}, x AS (SELECT * FROM f)", "unique_id", "t", STATE))
def q_drift_filter(spark, sf_dir):
    """Moments of the drifting line of hourly events, given the rows so far."""
    return moments(filtered(hourly(spark, sf_dir)))


@query(sql(f"{drifting(HOURLY)}, x AS (SELECT * FROM b)", "unique_id", "t", STATE))
def q_drift_smoother(spark, sf_dir):
    """Moments of the drifting line of hourly events, given all rows."""
    return moments(scan.smoother(filtered(hourly(spark, sf_dir)), ["unique_id"]))


@query(sql(f"{drifting(PANEL)}, x AS (SELECT * FROM b)", "unique_id", "t", STATE))
def q_drift_smoother_panel(spark, sf_dir):
    """The same for each nation's orders: many series share range partitions."""
    return moments(scan.smoother(filtered(panel(spark, sf_dir)), ["unique_id"]))


# ---- the mixture step -----------------------------------------------------------------------------------------------

MU, PHI, SD = -0.5, 0.95, 0.15
_MIXTURE = f"""k AS (SELECT * FROM (VALUES {', '.join(f'({j}, {p!r}, {m!r}, {v!r})' for j, (p, m, v) in enumerate(zip(MIX_P.tolist(), MIX_M.tolist(), MIX_V.tolist())))}) k(pos, kp, km, kv)),
l AS (SELECT unique_id, t, n - 1 AS last, ln(z * z + 1e-10) AS u FROM z),
w AS (SELECT unique_id, t, last, u, pos, km, kv, exp(ln(kp) - 0.5 * ln(kv) - 0.5 * power(u - {MU} - km, 2) / kv) AS e FROM l, k),
r AS (SELECT *, e / sum(e) OVER (PARTITION BY unique_id, t) AS val FROM w)"""


@query(sql(f"{HOURLY}, {SCALED}, {_MIXTURE}, x AS (SELECT * FROM r)", "unique_id", "t pos", "val"))
def q_mixture_weights(spark, sf_dir):
    """The probabilities of the ten components for each hour, at a fixed level."""
    d = designed(hourly(spark, sf_dir), config())[0]
    weights = volatility.mixture_weights(volatility.log_square(F.col("z")), F.lit(MU))
    return tidy(d.select("unique_id", "t", F.posexplode(weights).alias("pos", "val")))


_LEVEL = f"""RECURSIVE {HOURLY}, {SCALED}, {_MIXTURE},
o AS (SELECT unique_id, t, any_value(last) AS last, any_value(u) - sum(val * km) - {MU} AS y, sum(val * (kv + km * km)) - power(sum(val * km), 2) AS v FROM r GROUP BY unique_id, t),
f AS (SELECT unique_id, t, last, a / (a + v) * y AS m, a - a * a / (a + v) AS p FROM (SELECT *, {SD * SD!r} / (1 - {PHI} * {PHI}) AS a FROM o WHERE t = 0)
  UNION ALL SELECT unique_id, t, last, m + a / (a + v) * (y - m) AS m, a - a * a / (a + v) AS p
  FROM (SELECT o.*, {PHI} * m AS m, {PHI} * {PHI} * p + {SD * SD!r} AS a FROM f JOIN o ON o.unique_id = f.unique_id AND o.t = f.t + 1)),
b AS (SELECT unique_id, t, m, p FROM f WHERE t = last
  UNION ALL SELECT unique_id, t, m + g * (later - {PHI} * m) AS m, p + g * g * (after - a) AS p
  FROM (SELECT *, {PHI} * p / a AS g FROM (SELECT f.*, {PHI} * {PHI} * f.p + {SD * SD!r} AS a, b.m AS later, b.p AS after FROM b JOIN f ON f.unique_id = b.unique_id AND f.t = b.t - 1))),
x AS (SELECT unique_id, t, {MU} + m AS level, p AS var FROM b)"""


@query(sql(_LEVEL, "unique_id", "t", "level var"))
def q_volatility_level(spark, sf_dir):
    """The smoothed log variance of hourly events around a fixed level."""
    d = designed(hourly(spark, sf_dir), config())[0]
    return tidy(volatility.smoothed_level(d, ["unique_id"], ["t"], F.col("z"), F.lit(MU), PHI, SD))
