"""The scan against the sequential recursions, and the mixture step against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.operators import scan, volatility
from loomcast.operators.gibbs import MIX_M, MIX_P, MIX_V

SERIES = {"a": 200, "b": 1, "c": 7, "d": 50}
Q = 0.05


def moments(x, y, v, phi, start):
    """Filtered and smoothed moments, row by row."""
    n, d = x.shape
    m, p, ms, ps = np.zeros(d), np.eye(d) * start, [], []
    for k in range(n):
        if k:
            m, p = phi * m, phi * phi * p + Q * np.eye(d)
        s = x[k] @ p @ x[k] + v[k]
        gain = p @ x[k] / s
        m, p = m + gain * (y[k] - x[k] @ m), p - np.outer(gain, gain) * s
        ms.append(m)
        ps.append(p)
    sm, sp = [ms[-1]], [ps[-1]]
    for k in range(n - 2, -1, -1):
        ahead = phi * phi * ps[k] + Q * np.eye(d)
        g = phi * ps[k] @ np.linalg.inv(ahead)
        sm.insert(0, ms[k] + g @ (sm[0] - phi * ms[k]))
        sp.insert(0, ps[k] + g @ (sp[0] - ahead) @ g.T)
    return ms, ps, sm, sp


@pytest.mark.parametrize(("phi", "start", "d"), [(1.0, 100.05, 2), (0.9, 2.0, 1), (1.0, 5.0, 3)])
@pytest.mark.parametrize("part", [1000, 20])
def test_moments_are_those_of_the_recursion(spark, phi, start, d, part):
    g = np.random.default_rng(d)
    rows, want = [], {}
    for s, n in SERIES.items():
        x, y, v = g.normal(size=(n, d)), g.normal(size=n), g.uniform(0.2, 2, n)
        want[s] = moments(x, y, v, phi, start)
        rows += [(s, 3 * k, float(y[k]), x[k].tolist(), float(v[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, t int, y double, x array<double>, v double").repartition(3)
    found = scan.kalman_filter(df, ["g"], ["t"], F.col("y"), F.col("x"), F.col("v"), F.lit(Q), phi, start, part)
    for frame, at in ((found, 0), (scan.smoother(found, ["g"], phi, part), 2)):
        got = frame.collect()
        assert len(got) == len(rows)
        for r in got:
            assert np.allclose(r["mean"], want[r.g][at][r.t], atol=1e-10) and np.allclose(np.reshape(r["var"], (d, d)), want[r.g][at + 1][r.t], atol=1e-10)


def test_scan_and_total_of_any_length():
    join = lambda a, b: (np.char.add(a[0], b[0]),)  # noqa: E731  text tells the order of products
    for n in range(1, 40):
        e = (np.array([chr(97 + k) for k in range(n)]).astype("<U64"),)
        assert list(scan.scanned(e, join)[0]) == ["".join(e[0][: k + 1]) for k in range(n)]
        assert list(scan.total(e, join)[0]) == ["".join(e[0])]


def test_empty_series(spark):
    none = spark.createDataFrame([], "g string, t int, y double")
    found = scan.kalman_filter(none, ["g"], ["t"], F.col("y"), F.array(F.lit(1.0)), F.lit(1.0), F.lit(Q))
    assert found.count() == 0 and scan.smoother(found, ["g"]).count() == 0


def test_mixture_weights_and_moments(spark):
    values = [(0.0, 0.0), (1e-9, -3.0), (1e6, 0.5), (-2.0, 40.0)]
    df = spark.createDataFrame(values, "e double, level double")
    u = volatility.log_square(F.col("e"))
    for r in df.select("e", "level", volatility.mixture_weights(u, F.col("level")).alias("w")).withColumn("m", F.array(*volatility.mixture_moments(F.col("w")))).collect():
        log = np.log(MIX_P) - 0.5 * np.log(MIX_V) - 0.5 * (np.log(r.e * r.e + 1e-10) - r.level - MIX_M) ** 2 / MIX_V
        w = np.exp(log - log.max())
        w /= w.sum()
        assert np.allclose(r.w, w) and np.allclose(r.m, [w @ MIX_M, w @ (MIX_V + MIX_M**2) - (w @ MIX_M) ** 2])


def test_level_of_several_series(spark):
    g = np.random.default_rng(4)
    rows = [(s, k, float(g.normal() * np.exp(0.5 * c)), c) for s, n, c in (("a", 40, -1.0), ("b", 1, 2.0)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, t int, e double, mu double")
    got = {(r.g, r.t): r for r in volatility.smoothed_level(df, ["g"], ["t"], F.col("e"), F.col("mu"), part=15).collect()}
    assert len(got) == 41 and all(0 < r["var"] < 0.15**2 / (1 - 0.95**2) + 1e-12 for r in got.values())
    assert abs(np.mean([got["a", t].level for t in range(40)]) + 1.0) < 1.0 and abs(got["b", 0].level - 2.0) < 1.0
