"""Queries of forecast moments in closed form, over draws that SQL can repeat."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.config import ErrorConfig, ModelConfig, TrendConfig
from loomcast.operators import design as designs
from loomcast.operators import forecast, interpret
from loomcast.plans.queries import _FUTURE, PANEL, SCALED, H, config, designed, panel, stump
from loomcast.plans.registry import query, sql, tidy

DRAWS, PHI, SD = 3, 0.95, 0.15


def drawn(state: DataFrame) -> DataFrame:
    """Three draws for each series, by their number; the forest of the covariate is one stump."""
    d = F.col("draw")
    rows = state.select("unique_id", F.explode(F.array(*map(F.lit, range(DRAWS)))).alias("draw"))
    return rows.select(
        "unique_id", F.lit(0).alias("chain"), "draw", F.array(0.1 + 0.05 * d, 0.2 - 0.1 * d).alias("beta"), (0.3 + 0.1 * d).alias("sigma2"), (-0.4 + 0.3 * d).alias("h_last"),
        (-0.2 * d).alias("sv_mu"), F.array(stump(0, 6.0, -0.3, 0.1 * d)).alias("generic_trees"), F.lit(None).cast("string").alias("error"),
    )


def of(spark, sf_dir: str, cfg: ModelConfig) -> DataFrame:
    state = designs.feature_state(panel(spark, sf_dir).withColumn("x_step", F.lit(0.0)), cfg)
    future = designs.future_design(state, cfg, H)
    given = future.select("unique_id", "h", F.col("h").cast("double").alias("step")) if cfg.generic.covariates else None
    found = forecast.moments(drawn(state), state, future, cfg, given)
    return tidy(found.select("unique_id", "h", "t", "mean", F.sqrt("variance").alias("sd")), 2)


_DRAWS = f"{PANEL}, {SCALED}, {_FUTURE}, v AS (SELECT f.*, d, n + h AS t, (n + h) / (n - 1)::DOUBLE AS u, 0.1 + 0.05 * d AS b0, 0.2 - 0.1 * d AS b1 FROM f, range({DRAWS}) r(d))"
_MIXED = "x AS (SELECT unique_id, h, t, avg(y_mean + y_std * m) AS mean, sqrt(avg(y_std * y_std * s) + var_pop(y_std * m)) AS sd FROM p GROUP BY ALL)"
_VOLATILE = f"exp(-0.2 * d + power({PHI}, h + 1) * (-0.4 + 0.3 * d + 0.2 * d) + {SD * SD!r} * (1 - power({PHI}, 2 * (h + 1))) / (1 - {PHI * PHI!r}) / 2)"


@query(sql(f"{_DRAWS}, p AS (SELECT *, b0 + b1 * u AS m, {_VOLATILE} + greatest(100 / n::DOUBLE, 1e-6) * (h + 1) * (1 + u * u) AS s FROM v), {_MIXED}", "unique_id", "h t", "mean sd", digits=2))
def q_forecast_moments_drift(spark, sf_dir):
    """A walking trend with volatile noise."""
    return of(spark, sf_dir, replace(config(TrendConfig("tvp")), error=ErrorConfig("sv", sv_phi=PHI, sv_sigma_h=SD)))


@query(sql(f"{_DRAWS}, p AS (SELECT *, b0 + b1 * u + CASE WHEN h <= 6 THEN -0.3 ELSE 0.1 * d END AS m, 0.3 + 0.1 * d AS s FROM v), {_MIXED}", "unique_id", "h t", "mean sd", digits=2))
def q_forecast_moments_covariate(spark, sf_dir):
    """A line and a forest of one covariate with constant noise."""
    return of(spark, sf_dir, config(exog=("step",)))


_PARTS = f"""{PANEL}, {SCALED}, r AS (SELECT unique_id, 0 AS chain, d AS draw, t, z - (0.1 * d + 0.2 * u) - (CASE WHEN t % 12 < 6 THEN 0.3 ELSE -0.3 END) - 0.05 * (t % 5) * d AS residual FROM z, range({DRAWS}) r(d))"""


def posterior_of_parts(d: DataFrame) -> DataFrame:
    """A posterior as a fit makes it (a row for each draw, with the parts as arrays), that SQL can repeat."""
    rows = d.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("t", F.col("x_tr")[1].alias("u")))).alias("rows"))
    drawn = rows.withColumn("draw", F.explode(F.array(*map(F.lit, range(DRAWS)))))
    n = F.col("draw")
    return drawn.select(
        "unique_id", F.lit(0).alias("chain"), "draw", F.transform("rows", lambda r: 0.1 * n + 0.2 * r["u"]).alias("trend"),
        F.transform("rows", lambda r: F.when(r["t"] % 12 < 6, 0.3).otherwise(-0.3)).alias("seasonal"), F.transform("rows", lambda r: 0.05 * (r["t"] % 5) * n).alias("generic"),
    )


def left_over(spark, sf_dir: str) -> DataFrame:
    d, state = designed(panel(spark, sf_dir), config())
    return interpret.residuals(interpret.component_draws(posterior_of_parts(d), state), d)


@query(sql(f"{_PARTS}, x AS (SELECT * FROM r)", "unique_id", "chain draw t", "residual"))
def q_residuals(spark, sf_dir):
    """What the parts of each draw leave of each nation's orders."""
    return tidy(left_over(spark, sf_dir))


@query(sql(f"{_PARTS}, x AS (SELECT unique_id, chain, draw, count(*) AS n, avg(residual) AS mean, avg(residual * residual) AS variance, max(abs(residual)) AS most FROM r GROUP BY ALL)", "unique_id", "chain draw n", "mean variance most"))
def q_residual_moments(spark, sf_dir):
    return tidy(interpret.residual_moments(left_over(spark, sf_dir)))
