"""Operators against numpy, and the sampler against what it must recover."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loomcast import GenericConfig, MCMCConfig, ModelConfig, SeasonalConfig, SeasonalPeriod, SeriesModel, TrendConfig, make_config
from loomcast import config as settings
from loomcast.functions import bases
from loomcast.operators import design as designs
from loomcast.operators import diagnostics, fit, gibbs, interpret, metrics, trees
from loomcast.sources import series as sources
from loomcast.sources import synthetic


def frame(spark, y, unique_id="a", **more):
    n = len(y)
    return spark.createDataFrame(pd.DataFrame({"unique_id": unique_id, "ds": pd.date_range("2020-01-31", periods=n), "y": np.asarray(y, float), **more}))


def designed(spark, rows, cfg):
    state = designs.feature_state(rows, cfg)
    return designs.design(rows, state, cfg), state


# ---- settings


def test_config_json_round_trip():
    cfg = make_config(periods=[(12, 3), 7.5, SeasonalPeriod(4, 1)], calendar=["month"], lags=(1, 2), exog=["a"], errors="sv")
    assert settings.from_json(settings.to_json(cfg)) == cfg


@pytest.mark.parametrize("bad", [lambda: SeasonalPeriod(0), lambda: SeasonalPeriod(3, 0), lambda: TrendConfig("cubic"), lambda: SeasonalConfig(calendar=("moon",)), lambda: ModelConfig(multistep="direct"), lambda: SeriesModel(make_config(), trend="linear")])
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        bad()


def test_generic_prior_is_tighter():
    prior = GenericConfig().prior()
    assert prior.num_trees == 25 and prior.beta == 3.0 and abs(prior.leaf_sd() - 3 / (4 * 50**0.5)) < 1e-12
    assert GenericConfig(asymmetric=False).prior().num_trees == 50
    assert MCMCConfig(num_mcmc=10, thin=3).num_retained_draws() == 4


# ---- series and designs


def test_series_order_and_errors(spark):
    df = spark.createDataFrame([("b", "2020-01-02", 2.0), ("b", "2020-01-01", 1.0), ("a", "2020-01-01", 5.0)], "unique_id string, ds string, y double")
    got = {(r.unique_id, r.t): r.y for r in sources.series(df).collect()}
    assert got == {("b", 0): 1.0, ("b", 1): 2.0, ("a", 0): 5.0}
    with pytest.raises(ValueError):
        sources.single(df, "unique_id")
    with pytest.raises(Exception, match="null or NaN in series b"):
        sources.series(df.withColumn("y", F.when(F.col("y") == 2.0, None).otherwise(F.col("y")))).collect()
    with pytest.raises(ValueError, match="missing covariates"):
        sources.series(df, exog=["x"])


def test_short_series_names_itself(spark):
    with pytest.raises(Exception, match="no rows left after the lags in series a"):
        designs.feature_state(sources.series(frame(spark, [1.0, 2.0])), make_config(lags=(3,))).collect()


def test_spline_is_a_partition_of_unity(spark):
    rows = sources.series(frame(spark, np.arange(40.0)))
    cfg = make_config(lags=(2,))
    d, state = designed(spark, rows, cfg)
    x = np.array([r.x_tr for r in d.orderBy("t").collect()])
    assert x.shape == (38, len(cfg.trend.names()))
    dropped = 1 - x[:, 2:].sum(1)  # the first B-spline isn't a column
    assert (dropped > -1e-12).all() and abs(dropped[0] - 1) < 1e-12 and abs(dropped[-1]) < 1e-12
    future = designs.future_design(state, cfg, 3).orderBy("h").collect()
    assert all(f.x_tr[2:] == future[0].x_tr[2:] for f in future) and future[1].x_tr[1] > future[0].x_tr[1]


def test_lags_trim_and_names(spark):
    rows = sources.series(frame(spark, np.arange(80.0)))
    cfg = make_config(lags=(1, 2, 3), periods=[(12, 2)])
    d, state = designed(spark, rows, cfg)
    out = d.orderBy("t").collect()
    assert len(out) == 77 and out[0].t == 3 and out[-1].x_ge == [78.0, 77.0, 76.0]
    assert np.abs(np.mean([r.x_se for r in out], axis=0)).max() < 1e-10
    names = [r.name for r in designs.feature_names(state, cfg).where("block = 'generic'").orderBy("pos").collect()]
    assert names == ["y_lag1", "y_lag2", "y_lag3"]
    row = designs.future_row(state, rows, cfg, 0).first()
    assert row.t == 80 and row.x_ge == [79.0, 78.0, 77.0]


def test_frequency_months_and_days(spark):
    month = spark.sql("SELECT 'm' AS unique_id, add_months(DATE'2020-01-01', id) AS ds, 1.0 AS y FROM range(6)")
    day = spark.sql("SELECT 'd' AS unique_id, date_add(DATE'2020-01-01', int(id)) AS ds, 1.0 AS y FROM range(70)")
    got = {r.unique_id: (r.months, r.seconds) for r in sources.frequency(sources.series(month.union(day))).collect()}
    assert got == {"m": (1, 0), "d": (0, 86400)}


def test_frequency_and_next_times_of_month_ends_quarters_and_business_days(spark):
    times = {
        "month_end": pd.date_range("2020-01-31", periods=14, freq="ME"), "quarter": pd.date_range("2019-03-31", periods=6, freq="QE"), "first": pd.date_range("2020-01-15 06:00", periods=5, freq=pd.DateOffset(months=2)),
        "business": pd.date_range("2024-02-26 09:30", periods=11, freq="B"), "daily": pd.date_range("2024-02-26", periods=5, freq="D"), "hourly": pd.date_range("2024-02-26", periods=30, freq="h"),
    }
    rows = pd.concat([pd.DataFrame({"unique_id": k, "ds": v, "y": np.arange(len(v)) + 0.5}) for k, v in times.items()])
    s = sources.series(spark.createDataFrame(rows))
    cfg = make_config(trend="linear", lags=())
    got = {r.unique_id: (r.unit, r.months, r.seconds) for r in sources.frequency(s).collect()}
    assert got == {"month_end": ("month_end", 1, 0), "quarter": ("month_end", 3, 0), "first": ("month", 2, 0), "business": ("business_day", 0, 0), "daily": ("second", 0, 86400), "hourly": ("second", 0, 3600)}
    ahead = designs.future_times(designs.feature_state(s, cfg), 12, sources.frequency(s)).select("unique_id", "h", "ds").orderBy("unique_id", "h").toPandas()
    step = {"month_end": "ME", "quarter": "QE", "first": pd.DateOffset(months=2), "business": "B", "daily": "D", "hourly": "h"}
    for k, own in ahead.groupby("unique_id"):
        assert own["ds"].tolist() == pd.date_range(times[k][-1], periods=13, freq=step[k])[1:].tolist(), k


def test_forests_walk_as_expressions_do(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 2))
    z = np.sin(2 * x[:, 0]) + x[:, 1]
    draws = list(gibbs.run_chain(z, np.c_[np.ones(50), np.arange(50) / 49], np.empty((50, 0)), x, make_config(trend="linear", num_gfr=3, num_burnin=5, num_mcmc=3), rng))
    column = fit._column([d["generic_trees"] for d in draws], to_arrow_schema(fit.posterior_schema()).field("generic_trees").type)
    rows = spark.createDataFrame(pa.table({"draw": [d["draw"] for d in draws], "generic_trees": column}))
    forests = trees.Forests.of(column)
    want = np.array([d["generic"] for d in draws])
    assert np.allclose([forests.values(np.tile(r, (3, 1))) for r in x], want.T)
    assert np.allclose(forests.sums(x), want.sum(1))
    one = rows.select("draw", bases.forest_value(F.col("generic_trees"), bases.doubles(*map(float, x[7]))).alias("v")).orderBy("draw").collect()
    assert np.allclose([r.v for r in one], want[:, 7])


def test_trend_prior_penalises_second_differences():
    p = gibbs.trend_precision(np.array([False, False, True, True, True, True]), 10.0, 2.0)
    d = np.array([[1, -2, 1, 0], [0, 1, -2, 1]])
    want = np.eye(6) / 100
    want[2:, 2:] += 2 * d.T @ d
    assert np.allclose(p, want) and np.allclose(gibbs.trend_precision(np.array([False, True, True]), 10.0, 2.0), np.eye(3) / 100)


def test_blocks_share_no_features():
    with pytest.raises(AssertionError, match="share features"):
        designs.check_disjoint(ModelConfig(generic=_Renamed((1,))))


class _Renamed(GenericConfig):
    def names(self):
        return ["trend_t"]


class Level:
    """A block of one's own: a constant, drawn by its closed form."""

    def __init__(self, n):
        self.fit, self.beta = np.zeros(n), np.zeros(1)

    def sweep(self, r, var, rng, warm):
        r += self.fit
        p = (1 / var).sum() + 1.0
        self.beta = np.array([(r / var).sum() / p + rng.standard_normal() / np.sqrt(p)])
        self.fit = np.full(len(r), self.beta[0])
        r -= self.fit


def with_level(cfg, x_tr, x_se, x_ge):
    return gibbs.blocks_of(cfg, x_tr, x_se, x_ge) | {"trend": Level(len(x_tr))}


def test_a_block_of_ones_own_and_long_chains_in_batches(spark):
    cfg = make_config(trend="linear", lags=(), num_gfr=0, num_burnin=5, num_mcmc=150)
    d, _ = designed(spark, sources.series(frame(spark, np.sin(np.arange(60.0)))), cfg)
    p = fit.posterior(d, cfg, with_level).toPandas()
    assert len(p) == 150 and sorted(p["draw"]) == list(range(150)) and p["gap"].max() < 1e-10
    assert {len(b) for b in p["beta"]} == {1} and abs(p["trend"].map(lambda v: v[0]).mean()) < 0.1


def test_tree_value_routes_left_on_equal(spark):
    nodes = "array(named_struct('feat', 0, 'thresh', 1.0D, 'left', 1, 'right', 2, 'value', 0.0D), named_struct('feat', -1, 'thresh', 0.0D, 'left', -1, 'right', -1, 'value', 5.0D), named_struct('feat', -1, 'thresh', 0.0D, 'left', -1, 'right', -1, 'value', 7.0D))"
    got = spark.sql(f"SELECT array(v) AS x, {nodes} AS n FROM VALUES (1.0D), (1.5D) AS t(v)").select(bases.tree_value(F.col("n"), F.col("x")).alias("v")).collect()
    assert [r.v for r in got] == [5.0, 7.0]


# ---- scores and diagnostics


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, a, y = rng.normal(size=(5, 33)), rng.normal(size=5), rng.normal(size=20)
    s = spark.createDataFrame([(h, float(a[h]), float(v)) for h in range(5) for v in x[h]], "h int, actual double, sample double")
    train = spark.createDataFrame([(t, float(v)) for t, v in enumerate(y)], "t int, y double")
    got = metrics.evaluate(s, train).first()
    p, lo, hi = x.mean(1), np.quantile(x, 0.05, 1), np.quantile(x, 0.95, 1)
    crps = np.mean([np.abs(x[h] - a[h]).mean() - np.abs(x[h][:, None] - x[h][None]).mean() / 2 for h in range(5)])
    taus = np.arange(1, 20) / 20
    q = np.quantile(x, taus, axis=1)
    want = {
        "rmse": np.sqrt(((a - p) ** 2).mean()),
        "smape": np.mean(200 * np.abs(a - p) / (np.abs(a) + np.abs(p))),
        "mase": np.abs(a - p).mean() / np.abs(np.diff(y)).mean(),
        "crps": crps,
        "pinball": np.mean(np.maximum(taus[:, None] * (a - q), (taus[:, None] - 1) * (a - q))),
        "coverage": np.mean((a >= lo) & (a <= hi)),
        "interval_score": np.mean(hi - lo + 20 * np.maximum(lo - a, 0) + 20 * np.maximum(a - hi, 0)),
    }
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()), (got, want)


def test_diagnostics_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=(3, 60)), axis=1) * 0.2 + rng.normal(size=(3, 60))
    c = spark.createDataFrame([(k, t, float(v)) for k in range(3) for t, v in enumerate(x[k])], "chain int, draw int, value double")

    def rho(v, k):
        d = v - v.mean()
        return (d[:-k] * d[k:]).mean() / v.var()

    got = {(r.chain, r.lag): r.rho for r in diagnostics.autocorrelation(c, [1, 5]).collect()}
    assert all(abs(got[k, lag] - rho(x[k], lag)) < 1e-10 for k in range(3) for lag in (1, 5))
    for r in diagnostics.effective_size(c).collect():
        total = 0.0
        for k in range(1, 58, 2):
            pair = rho(x[r.chain], k) + rho(x[r.chain], k + 1)
            if pair < 0:
                break
            total += pair
        assert abs(r.ess - min(60, max(1, 60 / (1 + 2 * total)))) < 1e-8
    sizes = {r.chain: r.ess for r in diagnostics.effective_size(c).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # chains go on over many batches
    assert {r.chain: r.ess for r in diagnostics.effective_size(c).collect()} == pytest.approx(sizes)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    w, b = x.var(1, ddof=1).mean(), 60 * x.mean(1).var(ddof=1)
    assert abs(diagnostics.rhat(c).first().rhat - np.sqrt((59 / 60 * w + b / 60) / w)) < 1e-10
    with pytest.raises(Exception, match="two chains"):
        diagnostics.rhat(c.where("chain = 0")).collect()
    flat = c.withColumn("value", F.lit(1.0))
    assert diagnostics.rhat(flat).first().rhat == 1.0 and {r.rho for r in diagnostics.autocorrelation(flat, [1]).collect()} == {0.0}


# ---- the sampler


def test_chi_square_quantile():
    assert abs(gibbs.chi2_quantile(0.1, 3.0) - 0.5843743741551832) < 1e-9
    assert abs(gibbs.chi2_quantile(0.95, 1.0) - 3.841458820694124) < 1e-9


def test_moments_chain_has_the_closed_form(spark):
    rng = np.random.default_rng(3)
    cfg = make_config(trend="linear", lags=(), num_gfr=0, num_burnin=100, num_mcmc=1500)
    rows = sources.series(frame(spark, 1 + 0.05 * np.arange(120) + 0.7 * rng.normal(size=120)))
    d, _ = designed(spark, rows, cfg)
    moments = fit.trend_moments(d, 2)
    p = fit.moments_posterior(moments, cfg).toPandas()
    b = fit.ridge_line(moments, sigma2=float(p["sigma2"].mean())).first()
    mean = np.mean(p["beta"].tolist(), axis=0)
    assert abs(mean[0] - b.b0) < 0.02 and abs(mean[1] - b.b1) < 0.03
    again = fit.moments_posterior(moments.repartition(3), cfg).toPandas()
    assert np.allclose(p.sort_values("draw")["sigma2"], again.sort_values("draw")["sigma2"], rtol=1e-6)


@pytest.mark.parametrize("trend", ["tree", "linear", "spline", "tvp"])
@pytest.mark.parametrize("errors", ["homo", "sv"])
def test_variants(trend, errors):
    z = np.sin(np.arange(80) / 3.0) + np.arange(80) / 40.0
    z = (z - z.mean()) / z.std()
    cfg = make_config(trend=trend, errors=errors, num_gfr=2, num_burnin=5, num_mcmc=10, n_knots=5)
    u = np.arange(80) / 79
    x = {"tree": np.c_[u, u * u], "spline": np.c_[np.ones(80), u, np.maximum(0, 1 - 4 * np.abs(u[:, None] - np.linspace(0.2, 1, 6)))]}.get(trend, np.c_[np.ones(80), u])
    draws = list(gibbs.run_chain(z, x, np.c_[np.sin(np.arange(80) / 3.0)], np.c_[np.r_[0, z[:-1]]], cfg, np.random.default_rng(0)))
    assert len(draws) == 10 and max(d["gap"] for d in draws) < 1e-8
    assert all(np.isfinite(d["trend"]).all() for d in draws)
    for d in draws:  # flattened trees give back what they add to the fit
        assert len(d["generic_trees"]) == 25 and len(d["seasonal_trees"]) == 50


def test_line_season_and_noise_are_recovered(spark):
    rng = np.random.default_rng(4)
    t = np.arange(180)
    rows = frame(spark, 1 + 0.05 * t + 2 * np.sin(2 * np.pi * t / 12) + 0.3 * rng.normal(size=180))
    model = SeriesModel(trend="linear", periods=[(12, 2)], lags=(), num_gfr=5, num_burnin=60, num_mcmc=60).fit(rows)
    parts = model.decomposition().toPandas()
    seasonal = parts[parts.component == "seasonal"].sort_values("x")["mean"].to_numpy()
    assert np.corrcoef(seasonal, np.sin(2 * np.pi * t / 12))[0, 1] > 0.9
    sd = model.run.posterior.join(model.run.state, "unique_id").agg(F.avg(F.sqrt("sigma2") * F.col("y_std"))).first()[0]
    assert abs(sd - 0.3) < 0.12
    ahead = model.predict(12).orderBy("h").toPandas()
    slope = np.polyfit(np.arange(12), ahead["mean"] - 2 * np.sin(2 * np.pi * ahead["t"] / 12), 1)[0]
    assert abs(slope - 0.05) < 0.05
    wide = model.forecast_wide(2, levels=(80,)).orderBy("h").toPandas()
    assert (wide["model-lo-80"] < wide["model-hi-80"]).all() and str(wide["ds"][0])[:10] == "2020-07-29"


def test_volatility_follows_regimes():
    rng = np.random.default_rng(3)
    e = rng.normal(size=300) * np.sqrt(np.r_[np.full(150, 0.1), np.full(150, 2.0)])
    sv = gibbs.Volatility(0.95, 0.15, 10.0)
    var = np.mean([sv.draw(e, rng) for _ in range(40)][10:], axis=0)
    assert var[150:].mean() / var[:150].mean() > 3


def test_model_round_trip_partitions_and_errors(spark, tmp_path):
    rows = synthetic.trials(spark, 5, 2).where("t < 60")
    model = SeriesModel(trend="linear", lags=(1,), exog=["x"], num_gfr=1, num_burnin=3, num_mcmc=6, chains=2)
    with pytest.raises(RuntimeError):
        model.forecast(2)
    model.fit(rows, time=None, order="t")
    other = SeriesModel(model.config).fit(rows.repartition(5), time=None, order="t")
    key = ["unique_id", "chain", "draw"]
    pick = lambda m: m.run.posterior.select(*key, "sigma2").toPandas().sort_values(key)["sigma2"].to_numpy()
    assert len(pick(model)) == 24 and np.allclose(pick(model), pick(other), rtol=1e-9)
    model.save(str(tmp_path / "run"))
    back = SeriesModel.load(spark, str(tmp_path / "run"))
    assert back.config == model.config and np.array_equal(pick(back), pick(model))
    future = rows.where("t < 3").select("unique_id", F.col("t").alias("h"), "x")
    same = [m.forecast(3, future).mean().orderBy("unique_id", "h").toPandas()["mean"].to_numpy() for m in (model, back)]
    assert np.array_equal(*same)
    quiet = model.girf(3, future, future, common_noise=True).toPandas()
    assert np.abs(quiet["mean"]).max() < 1e-12
    with pytest.raises(ValueError, match="missing future covariates"):
        model.forecast(3)
    with pytest.raises(ValueError, match="at step 2"):
        model.forecast(3, future.where("h < 2"))
    with pytest.raises(ValueError, match="not a forest"):
        model.split_importance("trend")
    used = model.split_importance("generic").toPandas()
    assert set(used["feature"]) == {"y_lag1", "x_x"} and (used["inclusion_prob"] <= 1).all()
    assert model.partial_dependence("generic", 1, [0.0]).count() == 2


def test_calendar_needs_times(spark):
    with pytest.raises(ValueError, match="time"):
        SeriesModel(calendar=["month"]).fit(frame(spark, np.arange(30.0)), time=None)


def test_one_bad_series_leaves_the_others(spark):
    good = frame(spark, np.sin(np.arange(30.0)), "good")
    huge = frame(spark, [1e308 * (-1) ** k for k in range(30)], "huge")
    model = SeriesModel(trend="linear", lags=(), num_gfr=0, num_burnin=1, num_mcmc=2).fit(good.union(huge))
    counts = {r.unique_id: r["count"] for r in model.run.posterior.where("error IS NULL").groupBy("unique_id").count().collect()}
    assert counts["good"] == 2


def test_bands_are_linear_quantiles(spark):
    x = np.random.default_rng(5).normal(size=37)
    d = spark.createDataFrame([(0, float(v)) for v in x], "k int, value double")
    got = interpret.bands(d, ["k"]).first()
    assert abs(got["lower"] - np.quantile(x, 0.05)) < 1e-12 and abs(got["upper"] - np.quantile(x, 0.95)) < 1e-12


def test_partial_dependence_walks_draws_in_blocks(spark, monkeypatch):
    """No task holds all draws of a series; the means are those of plain loops."""
    from loomcast.operators.trees import Forests

    class Few:
        @staticmethod
        def of(column):
            assert len(column) <= 200
            return Forests.of(column)

    monkeypatch.setattr(interpret, "Forests", Few)
    monkeypatch.setattr(interpret, "DRAWS", 100, raising=False)
    monkeypatch.setattr(interpret, "ROWS", 20)
    node = "struct<feat:int,thresh:double,left:int,right:int,value:double>"
    trees = lambda d: [[(d % 2, d / 400, 1, 2, 0.0), (-1, 0.0, -1, -1, -1.0), (-1, 0.0, -1, -1, float(d))]]
    posterior = spark.createDataFrame([("s", 0, d, trees(d)) for d in range(400)], f"unique_id string, chain int, draw long, generic_trees array<array<{node}>>")
    b = [k / 50 for k in range(50)]
    design = spark.createDataFrame([("s", k, [0.5, x]) for k, x in enumerate(b)], "unique_id string, t long, x_ge array<double>")
    state = spark.createDataFrame([("s", 3.0)], "unique_id string, y_std double")
    got = interpret.partial_dependence(posterior, design, state, "generic", 0, [0.25, 0.75]).orderBy("x").collect()
    for r, g in zip(got, (0.25, 0.75)):
        want = [3.0 * np.mean([-1.0 if (x if d % 2 else g) <= d / 400 else d for x in b]) for d in range(400)]
        assert r.x == g and (r["mean"], r.lower, r.upper) == pytest.approx((np.mean(want), np.quantile(want, 0.05), np.quantile(want, 0.95)))
