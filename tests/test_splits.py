"""The split search against plain loops over rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.config import TreePrior
from loomcast.functions import bases
from loomcast.operators import splits

SCALE2 = 0.5


def evidence(w, r):
    a, p, q = 1 / SCALE2, w.sum(), (w * r).sum()
    return 0.5 * math.log(a / (a + p)) + 0.5 * q * q / (a + p)


def plain_best(x, w, r, least):
    """gain, feature, cut of the best cut; null (nan) features go right."""
    found = []
    for f in range(x.shape[1]):
        for cut in np.unique(x[~np.isnan(x[:, f]), f]):
            left = x[:, f] <= cut
            if left.sum() >= least and (~left).sum() >= max(1, least):
                found.append((round(evidence(w[left], r[left]) + evidence(w[~left], r[~left]) - evidence(w, r), 6), -f, -cut))
    return max(found, default=None)


def plain_tree(x, w, r, node, level, depth, prior, out):
    best = plain_best(x, w, r, prior.min_samples_leaf if prior else 1) if level < depth else None
    split = best is not None and best[0] + (splits.log_prior(level, prior) if prior else 0.0) > 0
    out[node] = (-best[1] if split else -1, -best[2] if split else None, len(r), (w * r).sum() / (1 / SCALE2 + w.sum()))
    if split:
        left = x[:, -best[1]] <= -best[2]
        for side, keep in ((1, left), (2, ~left)):
            plain_tree(x[keep], w[keep], r[keep], 2 * node + side, level + 1, depth, prior, out)


@pytest.fixture(scope="module")
def data(spark):
    g = np.random.default_rng(5)
    n = 400
    x = np.c_[g.integers(0, 6, n), g.normal(size=n).round(1), np.ones(n)].astype(float)
    x[g.random(n) < 0.05, 1] = np.nan
    r = (x[:, 0] > 2) * 1.0 + (np.nan_to_num(x[:, 1], nan=3.0) > 0.3) * (x[:, 0] <= 2) * 2.0 + g.normal(0, 0.3, n)
    w, group = g.uniform(0.5, 2.0, n), g.integers(0, 3, n)
    rows = [(None if k == 2 else int(k), *(None if np.isnan(v) else float(v) for v in xs), float(ww), float(rr)) for k, xs, ww, rr in zip(group, x, w, r)]
    rows.append((7, 1.0, 1.0, 1.0, 1.0, 0.5))  # a group of one row has no cut
    return spark.createDataFrame(rows, "g int, a double, b double, c double, w double, r double").cache(), group, x, w, r


@pytest.mark.parametrize(("prior", "part"), [(None, 1000), (None, 40), (TreePrior(min_samples_leaf=15), 100)])
def test_greedy_trees(data, prior, part):
    rows, group, x, w, r = data
    got = {}
    for n in splits.grow(rows, ["a", "b", "c"], 3, SCALE2, prior, ["g"], part).collect():
        got.setdefault(n.g, {})[n.node] = (n.feature, n.cut, n.n, n.value)
    for k in range(3):
        want, of = {}, group == k
        plain_tree(x[of], w[of], r[of], 0, 0, 3, prior, want)
        mine = got[None if k == 2 else k]
        assert len(want) > 5 and {n: v[:3] for n, v in mine.items()} == {n: v[:3] for n, v in want.items()}
        assert all(mine[n][3] == pytest.approx(v[3]) for n, v in want.items())
    assert set(got[7]) == {0} and got[7][0][0] == -1


def test_nodes_are_walked_as_rows_were_split(data):
    rows = data[0].where("b IS NOT NULL AND g IS NOT NULL")
    tree = splits.grow(rows, ["a", "b", "c"], 3, SCALE2, by=["g"])
    counts = {(r.g, round(r.value, 9)): r.n for r in tree.where("feature < 0").collect()}
    fitted = rows.join(splits.as_nodes(tree, ["g"]), "g").select("g", F.round(bases.tree_value(F.col("nodes"), F.array("a", "b", "c")), 9).alias("v"))
    assert {(r.g, r.v): r["count"] for r in fitted.groupBy("g", "v").count().collect()} == counts


def test_empty_table(data):
    none = data[0].limit(0)
    assert splits.cut_evidence(none, ["g"], ["a"], SCALE2).count() == 0
    assert splits.grow(none, ["a"], 2, SCALE2, by=["g"]).count() == 0


def test_rows_are_read_once_for_cuts_and_stored_once_for_a_tree(spark, data, monkeypatch):
    seen, tables = spark.sparkContext.accumulator(0), []

    def tick(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = data[0].mapInArrow(tick, data[0].schema)
    assert splits.cut_evidence(rows, ["g"], ["a", "b"], SCALE2).count() and seen.value == 401
    kept = splits.stored
    monkeypatch.setattr(splits, "stored", lambda df: tables.append(df.columns) or kept(df))
    assert splits.grow(rows, ["a", "b", "c"], 3, SCALE2, by=["g"]).count() > 15
    assert seen.value == 802 and sum("r" in columns for columns in tables) == 1
