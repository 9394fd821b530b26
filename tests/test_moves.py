"""Rated moves of trees against the sampler's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.config import TreePrior
from loomcast.functions.bases import NODE
from loomcast.operators import moves
from loomcast.operators.gibbs import Forest

PRIOR = TreePrior(num_trees=4, leaf_scale=0.7, min_samples_leaf=8)


@pytest.fixture(scope="module")
def grown(spark):
    """Two forests over data of their own, with what each tree sees."""
    rows, trees, forests = [], [], []
    for g in range(2):
        r = np.random.default_rng(g)
        n = 150
        x = np.c_[r.integers(0, 8, n), r.normal(size=n).round(1)].astype(float)
        y, var = (x[:, 0] > 3) * 2.0 + x[:, 1] * (x[:, 0] <= 3) + r.normal(0, 0.2, n), r.uniform(0.5, 2.0, n)
        forest = Forest(x, PRIOR)
        for _ in range(6):
            forest.sweep(y.copy() - forest.fit, var, r, True)
        forests.append((forest, x, y, var))
        rows += [(g if g else None, *map(float, xs), float(1 / v), float(z)) for xs, v, z in zip(x, var, y)]
        trees += [(g if g else None, k, [tuple(map(float, t)) for t in flat]) for k, flat in enumerate(forest.flat())]
    kind = NODE.replace("int", "double")
    nodes = spark.createDataFrame(trees, f"g int, tree int, nodes array<{kind}>").withColumn("nodes", F.col("nodes").cast(f"array<{NODE}>"))
    return spark.createDataFrame(rows, "g int, a double, b double, w double, r double").where("true"), nodes, forests


def numbered(tree):
    """Each node of a tree by the number that flat() gives it."""
    out = []

    def put(node):
        out.append(node)
        if node.feature >= 0:
            put(node.left)
            put(node.right)

    put(tree.root)
    return out


def test_structure(grown):
    shape = {(r.g, r.tree, r.node): r for r in moves.structure(grown[1], ["g", "tree"]).collect()}
    for g, (forest, *_) in zip((None, 1), grown[2]):
        for k, tree in enumerate(forest.trees):
            nodes = numbered(tree)
            twigs = {id(t) for t in tree.twigs()}
            assert len(nodes) > 1 and len([key for key in shape if key[:2] == (g, k)]) == len(nodes)
            for i, node in enumerate(nodes):
                r = shape[g, k, i]
                assert (r.depth, r.leaf, r.twig, r.leaves, r.twigs) == (node.depth, node.feature < 0, id(node) in twigs, len(tree.leaves), len(twigs))
                assert (r.up == -1) == (node.up is None) and (node.up is None or nodes[r.up] is node.up)


def test_ratios(grown):
    """Group by group: null keys don't join, so the null one is asked for by itself."""
    rows, trees, forests = grown
    for g, (forest, x, y, var) in zip((None, 1), forests):
        own = F.col("g").isNull() if g is None else F.col("g") == g
        args = (rows.where(own).drop("g"), trees.where(own).drop("g"), [], ["a", "b"], forest.scale, PRIOR)
        prune = {(r.tree, r.node): r.ratio for r in moves.prune_ratios(*args).collect()}
        grow = {(r.tree, r.node, r.feature, r.cut): r.ratio for r in moves.grow_ratios(*args, part=200).collect()}
        w, wr, wanted = 1 / var, y / var, 0
        for k, tree in enumerate(forest.trees):
            nodes, twigs = numbered(tree), tree.twigs()
            assert {n for t, n in prune if t == k} == {i for i, node in enumerate(nodes) if any(node is t for t in twigs)}
            for i, node in enumerate(nodes):
                if any(node is t for t in twigs):
                    gain = forest._gain(w, wr, node.left.rows, node.right.rows)
                    assert prune[k, i] == pytest.approx(-forest._ratio(node, gain, node is tree.root, len(tree.leaves) - 1, len(twigs)))
                if node.feature >= 0:
                    continue
                for f in range(2):
                    codes, cuts = forest._cuts(node.rows, f)
                    for cut in cuts:
                        gain = forest._gain(w, wr, node.rows[codes <= cut], node.rows[codes > cut])
                        sibling = None if node.up is None else node.up.right if node.up.left is node else node.up.left
                        after = len(twigs) + 1 - (sibling is not None and sibling.feature < 0)
                        wanted += 1
                        assert grow[k, i, f, forest.levels[f][cut]] == pytest.approx(forest._ratio(node, gain, len(tree.leaves) == 1, len(tree.leaves), after))
        assert wanted == len(grow)


def test_depth_limit_and_empty_tables(grown):
    rows, trees, _ = grown
    limited = TreePrior(min_samples_leaf=1, max_depth=0)
    assert moves.grow_ratios(rows.where("g = 1"), trees, ["g"], ["a"], 0.5, limited).count() == 0
    assert moves.prune_ratios(rows.limit(0), trees, ["g"], ["a", "b"], 0.5, PRIOR).count() == moves.structure(trees, ["g", "tree"]).where("twig").count()  # twigs with empty leaves
    assert moves.grow_ratios(rows, trees.limit(0), ["g"], ["a"], 0.5, PRIOR).count() == 0


def test_rows_are_placed_once(spark, grown, monkeypatch):
    """Few trees are walked as conditions, in one pass over the rows; more by arrays, with the same ratios, nulls too."""
    rows, trees, _ = grown
    rows = rows.select("a", F.when(F.col("b") < 1.5, F.col("b")).alias("b"), "w", "r")
    seen = spark.sparkContext.accumulator(0)

    def tick(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    found = []
    for known in (moves.KNOWN, 0):
        monkeypatch.setattr(moves, "KNOWN", known)
        before = seen.value
        got = moves.grow_ratios(rows.mapInArrow(tick, rows.schema), trees.where("g = 1").drop("g"), [], ["a", "b"], 0.7, PRIOR).collect()
        assert seen.value - before == 300
        found.append({(r.tree, r.node, r.feature, r.cut): r.ratio for r in got})
    assert len(found[0]) > 20 and found[0] == pytest.approx(found[1])
