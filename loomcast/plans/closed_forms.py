"""Queries of posterior means and residual variances in closed form, over designs of any width."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from loomcast.config import TrendConfig
from loomcast.operators import fit
from loomcast.plans.queries import _KNOT, PANEL, SCALED, _cox_de_boor, config, designed, lagged, panel, seasons, waves
from loomcast.plans.registry import query, sql, tidy

SPLINE = TrendConfig("spline")
WIDTH = len(SPLINE.names())
SIGMA2 = 0.25


def gram(width: int, source: str = "w") -> str:
    """gm: entries of an augmented matrix as columns, g<i>_<j>, from long rows (unique_id, t, pos, val)."""
    cells = ", ".join(f"coalesce(max(CASE WHEN i = {i} AND j = {j} THEN g END), 0) AS g{i}_{j}" for i in range(width) for j in range(i, width))
    return f"""pairs AS (SELECT a.unique_id, a.pos AS i, b.pos AS j, sum(a.val * b.val) AS g FROM {source} a JOIN {source} b USING (unique_id, t) WHERE a.pos <= b.pos GROUP BY ALL),
gm AS (SELECT unique_id, {cells} FROM pairs GROUP BY unique_id)"""


def at(i: int, j: int) -> str:
    return f"g{min(i, j)}_{max(i, j)}"


def eliminated(pivots: Sequence[int], width: int, source: str = "gm0", least: float = 1e-9) -> str:
    """Tables e<k>: after each pivot its row and column are projected out; columns with nothing left are passed over."""
    out, before = [], source
    for k in pivots:
        live = [(i, j) for i in range(width) for j in range(i, width) if k not in (i, j) and (i not in pivots or pivots.index(i) > pivots.index(k))]
        cells = ", ".join(f"{at(i, j)} - CASE WHEN {at(k, k)} > {least!r} * d{k} THEN {at(i, k)} * {at(k, j)} / {at(k, k)} ELSE 0 END AS {at(i, j)}" for i, j in live)
        dropped = ", ".join(f"d{i}" for i in pivots if pivots.index(i) > pivots.index(k))
        out.append(f"e{k} AS (SELECT unique_id, rank + CASE WHEN {at(k, k)} > {least!r} * d{k} THEN 1 ELSE 0 END AS rank, {dropped + ', ' if dropped else ''}{cells} FROM {before})")
        before = f"e{k}"
    return ", ".join(out)


def penalty(width: int) -> str:
    """p (i, j, g): a ridge on all coefficients, second differences of those from position 2 on."""
    return f"""p AS (SELECT i, j, CASE WHEN i = j THEN 0.01 ELSE 0 END + sum(CASE WHEN i >= 2 AND j >= 2 AND i - k BETWEEN 0 AND 2 AND j - k BETWEEN 0 AND 2 THEN [1, -2, 1][(i - k + 1)::INT] * [1, -2, 1][(j - k + 1)::INT] ELSE 0 END) AS g
  FROM range({width}) a(i), range({width}) b(j), range(2, {width - 2}) c(k) GROUP BY i, j)"""


def gauss_jordan(width: int) -> str:
    """x: unique_id, pos, beta from sy (unique_id, a<i>_<j>, b<i>)."""
    out, before = [], "sy"
    for k in range(width):
        cells = [f"a{k}_{j}" for j in range(k, width)] + [f"b{k}"]
        for i in range(width):
            if i != k:
                cells += [f"a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} AS a{i}_{j}" for j in range(k + 1, width)] + [f"b{i} - a{i}_{k} / a{k}_{k} * b{k} AS b{i}"]
                if i < k:
                    cells.append(f"a{i}_{i}")
        out.append(f"j{k} AS (SELECT unique_id, {', '.join(dict.fromkeys(cells))} FROM {before})")
        before = f"j{k}"
    return ", ".join(out) + ", x AS (" + " UNION ALL ".join(f"SELECT unique_id, {i} AS pos, b{i} / a{i}_{i} AS beta FROM {before}" for i in range(width)) + ")"


_BASIS = f"{PANEL}, {SCALED}, {_KNOT}, {_cox_de_boor().replace('x AS (', 'w AS (', 1)}"
_SYSTEM = f"""{_BASIS}, {penalty(WIDTH)},
h AS (SELECT a.unique_id, a.pos AS i, b.pos AS j, sum(a.val * b.val) AS g FROM w a JOIN w b USING (unique_id, t) GROUP BY ALL),
cr AS (SELECT unique_id, pos AS i, sum(val * z) AS c FROM w JOIN z USING (unique_id, t) GROUP BY ALL),
sy AS (SELECT h.unique_id, {', '.join(f'max(CASE WHEN i = {i} AND j = {j} THEN h.g / {SIGMA2!r} + p.g END) AS a{i}_{j}' for i in range(WIDTH) for j in range(WIDTH))},
  {', '.join(f'max(CASE WHEN i = {i} THEN c / {SIGMA2!r} END) AS b{i}' for i in range(WIDTH))}
  FROM h JOIN p USING (i, j) JOIN cr USING (unique_id, i) GROUP BY h.unique_id)"""


@query(sql(f"{_SYSTEM}, {gauss_jordan(WIDTH)}", "unique_id", "pos", "beta"))
def q_spline_posterior_mean(spark, sf_dir):
    """The penalised spline (13 columns) of each nation's orders."""
    d = designed(panel(spark, sf_dir), config(SPLINE))[0]
    return tidy(fit.posterior_mean(d, SPLINE, SIGMA2).select("unique_id", F.posexplode("beta").alias("pos", "beta")))


_FITTED = f"{_SYSTEM}, {gauss_jordan(WIDTH).replace('x AS (', 'beta AS (')}, x AS (SELECT unique_id, t, sum(val * beta) AS fitted FROM w JOIN beta USING (unique_id, pos) GROUP BY ALL)"


@query(sql(_FITTED, "unique_id", "t", "fitted"))
def q_spline_fitted(spark, sf_dir):
    """The penalised spline of each nation at its months."""
    d = designed(panel(spark, sf_dir), config(SPLINE))[0]
    beta = fit.posterior_mean(d, SPLINE, SIGMA2).withColumn("b", F.struct(F.lit(0).alias("chain"), F.lit(0).alias("draw")))
    paths = fit.trend_paths(beta.select("unique_id", "b.*", "beta", F.lit(None).cast("string").alias("error")), d)
    return tidy(paths.select("unique_id", "t", F.col("trend").alias("fitted")))


_FULL = WIDTH + 4 + 2  # spline, two harmonics, two lags
_DESIGN = f"""{PANEL}, {lagged(1, 2)},
c AS (SELECT unique_id, count(*) + 2 AS n, avg(y) AS y_mean, stddev_pop(y) AS y_std FROM g WHERE t >= 2 GROUP BY 1),
z AS (SELECT g.*, n, t / (n - 1)::DOUBLE AS u, (y - y_mean) / y_std AS z FROM g JOIN c USING (unique_id) WHERE t >= 2)"""


@query(sql(f"""{_DESIGN}, {_KNOT.replace("least(greatest(i - 3, 0), 9) / 9::DOUBLE AS val", "least(greatest(i - 3, 0), 9) / 9::DOUBLE + (1 - least(greatest(i - 3, 0), 9) / 9::DOUBLE) * (2 / (n - 1)::DOUBLE) AS val")}, {_cox_de_boor().replace('x AS (', 'w0 AS (', 1)},
w AS (SELECT * FROM w0 {' '.join(f"UNION ALL SELECT unique_id, t, {WIDTH + k} AS pos, {v} AS val FROM z" for k, v in enumerate([*waves((12, 2)), 'y_lag1', 'y_lag2', 'z', '1e0']))}),
{gram(_FULL + 2)}, gm0 AS (SELECT *, 0 AS rank, {', '.join(f'g{i}_{i} AS d{i}' for i in range(_FULL))} FROM gm), {eliminated(list(range(_FULL)), _FULL + 2, 'gm0')},
k2 AS (SELECT unique_id, count(*) AS n FROM z GROUP BY 1),
x AS (SELECT unique_id, n, rank, greatest(g{_FULL}_{_FULL} / n - power(g{_FULL}_{_FULL + 1} / n, 2), 1e-3) AS sigma2 FROM e{_FULL - 1} JOIN k2 USING (unique_id))""",
    "unique_id", "n rank", "sigma2"))
def q_full_design_sigma2(spark, sf_dir):
    """What least squares on spline, two harmonics and two lags leaves of each nation's orders; the spline and its line
    share a direction, so the design has a rank of one less than its columns."""
    d = designed(panel(spark, sf_dir), config(SPLINE, seasons((12, 2)), (1, 2)))[0]
    return tidy(fit.design_variance(d, _FULL))
