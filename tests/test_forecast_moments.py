"""Simulated forecasts, and responses with noise of their own, within bounds of the closed moments."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.config import ErrorConfig, GenericConfig, ModelConfig, SeasonalConfig, SeasonalPeriod, TrendConfig
from loomcast.operators import design as designs
from loomcast.operators import forecast
from loomcast.plans.queries import leaf, stump
from loomcast.sources import series as sources

H, DRAWS = 5, 4000
BASE = ModelConfig(TrendConfig("linear"), SeasonalConfig(), GenericConfig(()))
CASES = {
    "line": BASE,
    "drift": replace(BASE, trend=TrendConfig("tvp", coef_scale=2.0)),
    "volatile": replace(BASE, error=ErrorConfig("sv", sv_phi=0.8, sv_sigma_h=0.5)),
    "drift, volatile, season": replace(BASE, trend=TrendConfig("tvp"), seasonal=SeasonalConfig((SeasonalPeriod(4, 1),)), error=ErrorConfig("sv")),
    "tree, covariate": replace(BASE, trend=TrendConfig("tree"), generic=GenericConfig((), ("c",))),
}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(u, t, float((t * 7) % 5 + t / 9)) for u in ("a", "b") for t in range(40)], "unique_id string, o int, y double")
    return sources.series(df, time=None, order="o").withColumn("x_c", F.lit(0.0))


def drawn(state):
    odd = F.col("draw") % 2
    return state.select("unique_id", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("draw")).select(
        "unique_id", F.lit(0).alias("chain"), "draw", F.array(0.2 + 0.3 * odd, F.lit(0.4)).alias("beta"), F.lit(0.5).alias("sigma2"), F.lit(-0.5).alias("h_last"), F.lit(0.3).alias("sv_mu"),
        F.array(stump(0, 0.9, 0.0, 1.0)).alias("trend_trees"), F.array(stump(0, 0.5, -1.0, 1.0), F.array(leaf(0.1))).alias("seasonal_trees"), F.array(stump(0, 1.5, -0.2, 0.7)).alias("generic_trees"), F.lit(None).cast("string").alias("error"),
    )


@pytest.mark.parametrize("name", list(CASES))
def test_samples_lie_within_bounds(rows, name):
    cfg = CASES[name]
    state = designs.feature_state(rows, cfg)
    future = designs.future_design(state, cfg, H)
    given = future.select("unique_id", "h", F.col("h").cast("double").alias("c")) if cfg.generic.covariates else None
    want = {(r.unique_id, r.h): r for r in forecast.moments(drawn(state), state, future, cfg, given).collect()}
    assert len(want) == 2 * H
    samples = [forecast.simulate(drawn(state), state, future, rows, cfg, H, given, call).toPandas() for call in (0, 1)]
    for key, of in samples[0].groupby(["unique_id", "h"]):
        x, m, v = of["sample"].to_numpy(), want[key]["mean"], want[key]["variance"]
        fourth = ((x - x.mean()) ** 4).mean()
        assert abs(x.mean() - m) < 5 * np.sqrt(v / DRAWS) and abs(x.var() - v) < 6 * np.sqrt((fourth - v * v) / DRAWS) + 0.02 * v
    both = samples[0].merge(samples[1], on=["unique_id", "chain", "draw", "h"])
    for key, of in both.groupby(["unique_id", "h"]):  # a response with noise of its own: no mean, twice the variance within draws
        gap, means = (of["sample_x"] - of["sample_y"]).to_numpy(), of["draw"] % 2
        within = want[key]["variance"] - np.var([of.loc[means == k, ["sample_x", "sample_y"]].to_numpy().mean() for k in (0, 1)])
        assert abs(gap.mean()) < 5 * np.sqrt(2 * within / DRAWS) and gap.var() == pytest.approx(2 * within, rel=0.25)


def test_what_has_no_closed_form_is_refused(rows):
    cfg = replace(BASE, generic=GenericConfig((1,)))
    state = designs.feature_state(rows, cfg)
    with pytest.raises(ValueError, match="no closed form"):
        forecast.moments(drawn(state), state, designs.future_design(state, cfg, H), cfg)
    cfg = CASES["tree, covariate"]
    with pytest.raises(ValueError, match="missing future covariates"):
        forecast.moments(drawn(state), state, designs.future_design(state, cfg, H), cfg)
