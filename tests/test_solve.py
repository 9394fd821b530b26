"""Array solvers against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.config import TrendConfig
from loomcast.operators import fit, solve
from loomcast.operators.gibbs import trend_precision


def frame(spark, groups, name="x"):
    """g, x (a row's columns) and z."""
    rows = [(g, [float(v) for v in r], float(z)) for g, (x, zs) in groups.items() for r, z in zip(x, zs)]
    return spark.createDataFrame(rows, f"g int, {name} array<double>, z double")


def sparse(g, n, width):
    x = g.normal(size=(n, width))
    x[g.random((n, width)) < 0.6] = 0.0
    return x


@pytest.mark.parametrize("width", [1, 2, 13, 40])
def test_normal_equations_and_solve(spark, width):
    g = np.random.default_rng(width)
    groups = {k: (sparse(g, 60 + k, width), g.normal(size=60 + k)) for k in range(3)}
    sums = solve.normal_equations(frame(spark, groups), ["g"], F.concat("x", F.array("z")), width + 1)
    a = F.transform(F.slice("a", 1, width), lambda r: F.slice(r, 1, width))
    ready = sums.select("g", solve.plus(a, solve.matrix(np.eye(width) * 0.3)).alias("s"), F.transform(F.slice("a", 1, width), lambda r: F.get(r, F.lit(width))).alias("c"))
    for row in ready.withColumn("low", solve.cholesky(F.col("s"))).withColumn("b", solve.solved(F.col("low"), F.col("c"))).collect():
        x, z = groups[row.g]
        assert np.allclose(row.s, x.T @ x + 0.3 * np.eye(width)) and np.allclose(row.c, x.T @ z)
        assert [len(r) for r in row.low] == list(range(1, width + 1))
        assert np.allclose(row.b, np.linalg.solve(x.T @ x + 0.3 * np.eye(width), x.T @ z), rtol=1e-8, atol=1e-10)


@pytest.mark.parametrize("penalised", [0, 2, 11])
def test_posterior_mean_of_any_trend(spark, penalised):
    g = np.random.default_rng(penalised)
    trend = TrendConfig("linear", degree=3) if not penalised else TrendConfig("spline", n_knots=penalised - 1 if penalised > 2 else 2, spline_degree=3 if penalised > 2 else 2)
    width = len(trend.names())
    x, z = sparse(g, 50, width), g.normal(size=50)
    got = fit.posterior_mean(frame(spark, {1: (x, z)}), trend, 0.5, ("g",), "x").first()
    prior = trend_precision(np.array(trend.penalised()), trend.coef_scale, trend.smoothing)
    assert got.n == 50 and np.allclose(got.beta, np.linalg.solve(x.T @ x / 0.5 + prior, x.T @ z / 0.5))


def test_other_trends_are_refused(spark):
    with pytest.raises(ValueError, match="no coefficients"):
        fit.posterior_mean(frame(spark, {1: (np.ones((2, 2)), [1, 2])}), TrendConfig("tree"), by=("g",), x="x")


def test_variance_of_deficient_and_shifted_designs(spark):
    g = np.random.default_rng(9)
    n = 40
    full = g.normal(size=(n, 5)) * np.array([1, 1e6, 1e-4, 1, 1])
    twice = np.c_[full[:, :3], full[:, 0] - 2 * full[:, 2], np.zeros(n)]
    saturated, z = g.normal(size=(4, 5)), g.normal(size=n) + 3.0
    designs = {1: (full, z), 2: (twice, z), 3: (saturated, z[:4]), 4: (np.zeros((n, 5)), z)}
    rows = frame(spark, designs).select("g", F.slice("x", 1, 2).alias("x_tr"), F.slice("x", 3, 2).alias("x_se"), F.slice("x", 5, 1).alias("x_ge"), "z")
    got = {r.g: r for r in fit.design_variance(rows, 5, ("g",)).collect()}
    for k, (x, zs) in designs.items():
        rest = zs - x @ np.linalg.lstsq(x, zs, rcond=None)[0]
        assert got[k].sigma2 == pytest.approx(max(np.var(rest), 1e-3), rel=1e-6) and got[k].n == len(zs)
    assert [got[k]["rank"] for k in designs] == [5, 3, 4, 0]


def test_empty_table(spark):
    none = frame(spark, {1: (np.ones((1, 2)), [1])}).limit(0)
    assert solve.normal_equations(none, ["g"], F.col("x"), 2).count() == 0
