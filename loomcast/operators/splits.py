"""Trees grown level by level over tables: the evidence of every cut by sorted prefix sums, the best cut of every node.

The node of a row is a column.  A level takes one pass: rows are counted by (group, node, feature, value), prefix sums of
precisions and weighted residuals over the sorted values give both sides of every cut, and one aggregation finds the best
cut of each node.  Nodes, features and groups of any size are spread over range partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.config import TreePrior
from loomcast.operators.order_stats import with_facts
from loomcast.operators.ranges import PART, Ranges
from loomcast.sources.shared import stored

LAZY = 4  # levels after which rows are stored with their nodes; between, each pass walks them down from there
DIGITS = 6  # evidence is compared up to so many digits, as the order of a sum decides what follows


def log_evidence(p: Column, q: Column, scale2: float) -> Column:
    """The log evidence of a leaf whose rows have precisions that sum to p and weighted residuals that sum to q."""
    a = 1.0 / scale2
    return 0.5 * F.log(F.lit(a) / (a + p)) + 0.5 * q * q / (a + p)


def log_prior(depth: int, prior: TreePrior) -> float:
    """What splitting a node at this depth adds to the log prior of a tree."""
    split = [prior.alpha * (1.0 + d) ** -prior.beta for d in (depth, depth + 1)]
    return math.log(split[0]) + 2.0 * math.log1p(-split[1]) - math.log1p(-split[0])


def cut_evidence(rows: DataFrame, by: Sequence[str], features: Sequence[str], scale2: float, least: int = 1, part: int = PART) -> DataFrame:
    """by, feature (position), cut, n_left, n_right and gain: for every cut that leaves `least` rows on both sides, what
    splitting there adds to the log evidence.  rows has by, the features as doubles, w (precisions) and r (residuals).

    Rows go left where the feature is at most the cut; the largest value is no cut.  Null features are on neither side:
    they make no cut, and as large values they would go right, so rows with one count there.
    """
    values = value_sums(rows, by, features)
    return evidence_of(values, node_sums(values, by), by, scale2, least, part)


def value_sums(rows: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """by, feature, cut, w, wr, c: sums over the rows of each value, the null one too, in the one pass that rows are read.

    The table is stored: what follows reads a row for each value, however often."""
    pairs = F.array(*(F.struct(F.lit(k).alias("feature"), F.col(f).cast("double").alias("cut")) for k, f in enumerate(features)))
    each = rows.select(*by, "w", (F.col("w") * F.col("r")).alias("wr"), F.explode(pairs).alias("e")).select(*by, "e.*", "w", "wr")
    return stored(each.groupBy(*by, "feature", "cut").agg(F.sum("w").alias("w"), F.sum("wr").alias("wr"), F.count("*").cast("double").alias("c")))


def node_sums(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, _p, _q, _n: the sums and the number of all rows; each row has one value of the first feature."""
    return values.where("feature = 0").groupBy(*by).agg(F.sum("w").alias("_p"), F.sum("wr").alias("_q"), F.round(F.sum("c")).cast("long").alias("_n"))


def evidence_of(values: DataFrame, totals: DataFrame, by: Sequence[str], scale2: float, least: int, part: int = PART) -> DataFrame:
    """What cut_evidence returns, from the sums of its rows by value and of all of them."""
    keys = [*by, "feature"]
    left = Ranges(values.where("cut IS NOT NULL"), keys, ["cut"], part).running({"p": F.col("w"), "q": F.col("wr"), "n": F.col("c")}, "_rank")
    sides = with_facts(left, totals, by)
    n_left = F.round("n").cast("long")
    both = sides.select(*keys, "cut", n_left.alias("n_left"), (F.col("_n") - n_left).alias("n_right"), "p", "q", "_p", "_q").where((F.col("n_left") >= least) & (F.col("n_right") >= max(1, least)))
    gain = log_evidence(F.col("p"), F.col("q"), scale2) + log_evidence(F.col("_p") - F.col("p"), F.col("_q") - F.col("q"), scale2) - log_evidence(F.col("_p"), F.col("_q"), scale2)
    return both.select(*keys, "cut", "n_left", "n_right", gain.alias("gain"))


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with the other columns of right on keys, of which nulls match."""
    named = right.withColumnsRenamed({c: f"_by_{c}" for c in keys})
    return left.join(named, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in keys)), how).drop(*(f"_by_{c}" for c in keys))


def best_cuts(evidence: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, feature, cut, gain: the cut with the largest gain; ties to the first feature, then the smallest cut."""
    order = F.struct(F.round("gain", DIGITS), -F.col("feature"), -F.col("cut"))
    return evidence.groupBy(*by).agg(F.max_by(F.struct("feature", "cut", "gain"), order).alias("b")).select(*by, "b.*")


def grow(rows: DataFrame, features: Sequence[str], depth: int, scale2: float, prior: TreePrior | None = None, by: Sequence[str] = (), part: int = PART) -> DataFrame:
    """by, node, feature, cut, n, value: the nodes of each group's greedy tree, up to `depth` levels of splits.

    rows has by, the features, w and r.  The root is node 0, the children of node k are 2 k + 1 and 2 k + 2.  A node is
    split by its best cut if that adds to the evidence and the prior of the tree together (to the evidence alone without a
    prior), and leaves prior.min_samples_leaf rows on both sides.  feature is -1 and cut null at leaves; value is the
    posterior mean of a leaf with the node's rows.
    """
    least = prior.min_samples_leaf if prior else 1
    keys, out = [*by, "node"], []
    now = stored(rows.select(*by, *(F.col(f).cast("double").alias(f) for f in features), F.col("w").cast("double").alias("w"), F.col("r").cast("double").alias("r"), F.lit(0).cast("long").alias("node")))
    mean = F.col("_q") / (1.0 / scale2 + F.col("_p"))
    for level in range(depth + 1):
        if level == depth:
            last = now.groupBy(*keys).agg(F.sum("w").alias("_p"), F.sum(F.col("w") * F.col("r")).alias("_q"), F.count("*").alias("_n"))
            out.append(last.select(*keys, F.lit(-1).alias("feature"), F.lit(None).cast("double").alias("cut"), F.col("_n").alias("n"), mean.alias("value")))
            break
        values = value_sums(now, keys, features)
        nodes = stored(node_sums(values, keys))
        cuts = best_cuts(evidence_of(values, nodes, keys, scale2, least, part), keys)
        cuts = stored(cuts.where(F.round("gain", DIGITS) + (log_prior(level, prior) if prior else 0.0) > 0.0).select(*keys, "feature", "cut"))
        out.append(matched(nodes, cuts, keys, "left").select(*keys, F.coalesce("feature", F.lit(-1)).alias("feature"), "cut", F.col("_n").alias("n"), mean.alias("value")))
        if cuts.first() is None:
            break
        split = with_facts(now, cuts, keys)
        value = F.element_at(F.array(*features), F.col("feature") + 1)
        right = F.when(value <= F.col("cut"), 1).otherwise(2)
        now = split.withColumn("node", 2 * F.col("node") + right).select(now.columns)
        if level % LAZY == LAZY - 1:
            now = stored(now)
    whole = out[0]
    for one in out[1:]:
        whole = whole.unionByName(one)
    return whole


def as_nodes(tree: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by and nodes: each tree as an array of nodes (functions.bases.NODE), which tree_value walks; bounded by its depth."""
    placed = F.array_sort(F.collect_list(F.struct("node", "feature", "cut", "value")))
    listed = tree.groupBy(*by).agg(placed.alias("e"))
    ids = F.transform("e", lambda e: e["node"])
    at = lambda node: (F.array_position(ids, node) - 1).cast("int")
    leaf = lambda e: e["feature"] < 0
    nodes = F.transform("e", lambda e: F.struct(
        e["feature"].cast("int").alias("feat"), F.coalesce(e["cut"], F.lit(0.0)).alias("thresh"),
        F.when(leaf(e), -1).otherwise(at(2 * e["node"] + 1)).cast("int").alias("left"), F.when(leaf(e), -1).otherwise(at(2 * e["node"] + 2)).cast("int").alias("right"),
        e["value"].alias("value"),
    ))
    return listed.select(*by, nodes.alias("nodes"))
