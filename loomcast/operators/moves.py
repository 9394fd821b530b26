"""Grow and prune moves of given trees over tables: what each candidate's acceptance hangs on, without the random draw.

A tree is an array of nodes (functions.bases.NODE).  Its structure (parents, depths, leaves, twigs) comes from higher-order
functions over the array; the rows of a leaf, of any number, are only summed (splits.cut_evidence for the cuts).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.config import TreePrior
from loomcast.functions.bases import let
from loomcast.operators.ranges import PART
from loomcast.operators.solve import indices
from loomcast.operators.splits import cut_evidence, log_evidence, matched


KNOWN = 256  # nodes of all trees together that are walked as conditions


def leaf_of(nodes: Column, x: Column) -> Column:
    """The number of the leaf that x reaches."""

    def step(at: Column, _: Column) -> Column:
        return let(F.get(nodes, at), lambda n: F.when(n["feat"] < 0, at).when(F.get(x, n["feat"]) <= n["thresh"], n["left"]).otherwise(n["right"]))

    return F.aggregate(nodes, F.lit(0), step)


def parents(nodes: Column) -> Column:
    """The parent of each node, -1 for the root."""
    index = indices(F.size(nodes))
    return F.transform(index, lambda i: F.coalesce(F.get(F.filter(index, lambda j: (F.get(nodes, j)["left"] == i) | (F.get(nodes, j)["right"] == i)), F.lit(0)), F.lit(-1)))


def depths(up: Column) -> Column:
    """The depth of each node, by its parents; a parent stands before its children."""
    return F.aggregate(up, F.array().cast("array<int>"), lambda done, p: F.concat(done, F.array(F.when(p < 0, 0).otherwise(F.coalesce(F.get(done, F.greatest(p, F.lit(0))), F.lit(0)) + 1))))


def structure(trees: DataFrame, by: Sequence[str], nodes: str = "nodes") -> DataFrame:
    """by, node, up, depth, left, right, leaf, twig, leaves, twigs and sibling_leaf of every node of the trees.

    A twig is an inner node of which both children are leaves; leaves and twigs count those of the tree.
    """
    n = F.col(nodes)
    is_leaf = lambda i: F.get(n, i)["feat"] < 0
    known = trees.select(*by, n.alias(nodes), parents(n).alias("_ups")).withColumn("_depths", depths(F.col("_ups")))
    twig = lambda i: ~is_leaf(i) & is_leaf(F.get(n, i)["left"]) & is_leaf(F.get(n, i)["right"])
    index = indices(F.size(n))
    count = lambda what: F.size(F.filter(index, what))

    def told(i: Column) -> Column:
        up = F.get(F.col("_ups"), i)
        over = F.get(n, F.greatest(up, F.lit(0)))
        other = F.when(over["left"] == i, over["right"]).otherwise(over["left"])
        return F.struct(
            i.alias("node"), up.alias("up"), F.get(F.col("_depths"), i).alias("depth"), F.get(n, i)["left"].alias("left"), F.get(n, i)["right"].alias("right"),
            is_leaf(i).alias("leaf"), F.when(is_leaf(i), False).otherwise(twig(i)).alias("twig"), F.when(up >= 0, is_leaf(other)).otherwise(False).alias("sibling_leaf"),
        )

    each = known.select(*by, count(is_leaf).alias("leaves"), count(lambda i: F.when(is_leaf(i), False).otherwise(twig(i))).alias("twigs"), F.explode(F.transform(index, told)).alias("_e"))
    return each.select(*by, "_e.*", "leaves", "twigs")


def prior_gain(depth: Column, prior: TreePrior) -> Column:
    """What splitting a node at this depth adds to the log prior of a tree."""
    split = lambda d: F.lit(prior.alpha) * F.pow(1.0 + d, F.lit(-prior.beta))
    return F.log(split(depth)) + 2.0 * F.log1p(-split(depth + 1)) - F.log1p(-split(depth))


def log_ratio(gain: Column, depth: Column, from_root: Column, leaves: Column, twigs: Column, prior: TreePrior) -> Column:
    """The log acceptance of growing a node, given the leaves of the tree before and its twigs after; of a tree that is a
    root alone only growing can be proposed."""
    return gain + prior_gain(depth, prior) + F.when(from_root, math.log(0.5)).otherwise(0.0) + F.log(leaves) - F.log(twigs)


def fixed_leaf(nodes: Sequence, x: Sequence[Column], at: int = 0) -> Column:
    """leaf_of as nested conditions, for a tree that the driver knows: Spark compiles them."""
    n = nodes[at]
    if n["feat"] < 0:
        return F.lit(at)
    return F.when(x[n["feat"]] <= F.lit(n["thresh"]), fixed_leaf(nodes, x, n["left"])).otherwise(fixed_leaf(nodes, x, n["right"]))


def placed(rows: DataFrame, trees: DataFrame, by: Sequence[str], tree: str, features: Sequence[str]) -> DataFrame:
    """by, tree, node (the leaf), the features, w and r: every row of a group under every tree of that group."""
    x = [F.col(f).cast("double") for f in features]
    if by:
        joined = rows.join(trees.select(*by, tree, "nodes"), list(by))
        return joined.select(*by, tree, leaf_of(F.col("nodes"), F.array(*x)).alias("node"), *features, "w", "r")
    few = trees.select(tree, "nodes").limit(KNOWN + 1).collect()
    if not few or len(few) > KNOWN or sum(len(t["nodes"]) for t in few) > KNOWN:
        joined = rows.join(F.broadcast(trees.select(tree, "nodes")))
        return joined.select(tree, leaf_of(F.col("nodes"), F.array(*x)).alias("node"), *features, "w", "r")
    each = F.array(*(F.struct(F.lit(t[tree]).cast(trees.schema[tree].dataType).alias(tree), fixed_leaf(t["nodes"], x).alias("node")) for t in few))
    return rows.select(F.explode(each).alias("_e"), *features, "w", "r").select(F.col(f"_e.{tree}").alias(tree), "_e.node", *features, "w", "r")


def grow_ratios(rows: DataFrame, trees: DataFrame, by: Sequence[str], features: Sequence[str], scale2: float, prior: TreePrior, tree: str = "tree", part: int = PART) -> DataFrame:
    """by, tree, node, feature, cut, ratio: the log acceptance of splitting each leaf by each cut that leaves enough rows.

    rows has by, the features, w (precisions) and r (residuals without the tree); trees has by, tree and nodes.  Without
    by, every row meets every tree, of which there should be few.
    """
    keys = [*by, tree, "node"]
    evidence = cut_evidence(placed(rows, trees, by, tree, features), keys, features, scale2, max(1, prior.min_samples_leaf), part)
    leaves = structure(trees, [*by, tree]).where("leaf")
    if prior.max_depth >= 0:
        leaves = leaves.where(F.col("depth") + 1 <= prior.max_depth)
    after = F.col("twigs") + 1 - F.col("sibling_leaf").cast("int")
    ratio = log_ratio(F.col("gain"), F.col("depth"), F.col("leaves") == 1, F.col("leaves"), after, prior)
    return matched(evidence, leaves, keys).select(*keys, "feature", "cut", ratio.alias("ratio"))


def prune_ratios(rows: DataFrame, trees: DataFrame, by: Sequence[str], features: Sequence[str], scale2: float, prior: TreePrior, tree: str = "tree") -> DataFrame:
    """by, tree, node, ratio: the log acceptance of taking back the split of each twig; its leaves may be empty."""
    keys = [*by, tree]
    sums = placed(rows, trees, by, tree, features).groupBy(*keys, "node").agg(F.sum("w").alias("p"), F.sum(F.col("w") * F.col("r")).alias("q"))
    twigs = structure(trees, keys).where("twig")
    for side in ("left", "right"):
        own = sums.select(*keys, F.col("node").alias(side), F.col("p").alias(f"p_{side}"), F.col("q").alias(f"q_{side}"))
        twigs = matched(twigs, own, [*keys, side], "left").fillna(0.0, [f"p_{side}", f"q_{side}"])
    parts = [log_evidence(F.col(f"p_{s}"), F.col(f"q_{s}"), scale2) for s in ("left", "right")]
    gain = parts[0] + parts[1] - log_evidence(F.col("p_left") + F.col("p_right"), F.col("q_left") + F.col("q_right"), scale2)
    ratio = -log_ratio(gain, F.col("depth"), F.col("node") == 0, F.col("leaves") - 1, F.col("twigs"), prior)
    return twigs.select(*keys, "node", ratio.alias("ratio"))
