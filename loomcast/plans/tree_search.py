"""Queries of the split search over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.config import TreePrior
from loomcast.functions import bases
from loomcast.operators import moves, splits
from loomcast.plans.queries import leaf, node
from loomcast.plans.registry import query, read, sql, tidy

SCALE2 = 0.5
PRIOR = TreePrior(min_samples_leaf=20)
FEATURES = ("l_quantity", "l_discount", "l_tax", "l_partkey")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a residual that follows from quantity, discount and price; larger taxes make them less precise."""
    kept = read(spark, sf_dir, "lineitem")
    residual = (F.col("l_quantity") * (1 - F.col("l_discount")) - 24) / 10 + (F.col("l_extendedprice") - 30000) / 20000
    return kept.select("l_returnflag", *(F.col(f).cast("double").alias(f) for f in FEATURES), (0.5 / (1.0 + F.col("l_tax"))).alias("w"), residual.alias("r"))


_LINES = f"e AS (SELECT l_returnflag, {', '.join(f'l.{f}::DOUBLE AS {f}' for f in FEATURES)}, 0.5 / (1e0 + l_tax) AS w, (l_quantity * (1 - l_discount) - 24) / 10 + (l_extendedprice - 30000) / 20000 AS r FROM lineitem l)"


def evidence(p: str, q: str) -> str:
    a = 1.0 / SCALE2
    return f"(0.5 * ln({a!r} / ({a!r} + {p})) + 0.5 * ({q}) * ({q}) / ({a!r} + {p}))"


def cuts_of(source: str, by: str, least: int, to: str) -> str:
    """Tables that end with `to`: by, feature, cut, n_left, n_right, gain of every cut of source."""
    long = " UNION ALL ".join(f"SELECT {by}, {k} AS feature, {f} AS cut, w, w * r AS wr FROM {source}" for k, f in enumerate(FEATURES))
    return f"""{to}l AS (SELECT {by}, feature, cut, sum(w) AS w, sum(wr) AS wr, count(*) AS c FROM ({long}) GROUP BY ALL),
{to}s AS (SELECT {by}, feature, cut, sum(w) OVER o AS p, sum(wr) OVER o AS q, sum(c) OVER o AS n_left FROM {to}l WINDOW o AS (PARTITION BY {by}, feature ORDER BY cut)),
{to}t AS (SELECT {by}, sum(w) AS pp, sum(w * r) AS qq, count(*) AS nn FROM {source} GROUP BY {by}),
{to} AS (SELECT {by}, feature, cut, n_left, nn - n_left AS n_right, {evidence('p', 'q')} + {evidence('(pp - p)', 'qq - q')} - {evidence('pp', 'qq')} AS gain
  FROM {to}s JOIN {to}t USING ({by}) WHERE n_left >= {least} AND nn - n_left >= {least})"""


@query(sql(f"{_LINES}, {cuts_of('e', 'l_returnflag', 1, 'x')}", "l_returnflag", "feature n_left n_right", "cut gain", digits=4))
def q_cut_evidence(spark, sf_dir):
    """What every cut of every feature adds to the evidence, by return flag."""
    return tidy(splits.cut_evidence(lines(spark, sf_dir), ["l_returnflag"], FEATURES, SCALE2), 4)


def levels(depth: int, by: str, prior: TreePrior | None) -> str:
    """x: by, node, feature, cut, n, value of the greedy trees, level by level."""
    keys, out, least = f"{by}, node", ["r0 AS (SELECT *, 0 AS node FROM e)"], prior.min_samples_leaf if prior else 1
    value = f"sum(w * r) / ({1.0 / SCALE2!r} + sum(w)) AS value"
    for k in range(depth):
        out.append(cuts_of(f"r{k}", keys, least, f"c{k}"))
        gate = splits.log_prior(k, prior) if prior else 0.0
        out.append(f"b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(gain, 6) DESC, feature, cut) AS place FROM c{k}) WHERE place = 1 AND round(gain, 6) + {gate!r} > 0)")
        out.append(f"n{k} AS (SELECT {by}, r.node, coalesce(any_value(feature), -1) AS feature, any_value(b.cut) AS cut, count(*) AS n, {value} FROM r{k} r LEFT JOIN b{k} b USING ({keys}) GROUP BY {by}, r.node)")
        picked = "CASE feature " + " ".join(f"WHEN {j} THEN {f}" for j, f in enumerate(FEATURES)) + " END"
        out.append(f"r{k + 1} AS (SELECT r.* REPLACE (2 * r.node + CASE WHEN {picked} <= cut THEN 1 ELSE 2 END AS node) FROM r{k} r JOIN b{k} USING ({keys}))")
    out.append(f"n{depth} AS (SELECT {by}, node, -1 AS feature, NULL AS cut, count(*) AS n, {value} FROM r{depth} GROUP BY {keys})")
    out.append("x AS (" + " UNION ALL ".join(f"SELECT {by}, node, feature, cut, n, value FROM n{k}" for k in range(depth + 1)) + ")")
    return ", ".join(out)


@query(sql(f"{_LINES}, {levels(3, 'l_returnflag', PRIOR)}", "l_returnflag", "node feature n", "cut value"))
def q_greedy_tree(spark, sf_dir):
    """A greedy tree of depth 3 for each return flag, over all lines."""
    return tidy(splits.grow(lines(spark, sf_dir), FEATURES, 3, SCALE2, PRIOR, ["l_returnflag"]))


_ONE = levels(2, "one", None).replace("SELECT *, 0 AS node FROM e", "SELECT *, 1 AS one, 0 AS node FROM e").replace("x AS (", "tree AS (")
_FITTED = f"""{_ONE}, leaf AS (SELECT l_returnflag, node FROM r0 ANTI JOIN b0 USING (node) UNION ALL SELECT l_returnflag, node FROM r1 ANTI JOIN b1 USING (node) UNION ALL SELECT l_returnflag, node FROM r2),
x AS (SELECT l_returnflag, value AS fitted, count(*) AS n FROM leaf JOIN tree USING (node) GROUP BY ALL)"""


@query(sql(f"{_LINES}, {_FITTED}", "l_returnflag", "n", "fitted"))
def q_tree_fit(spark, sf_dir):
    """How many lines of each return flag have each value of one greedy tree of depth 2 over all lines."""
    rows = lines(spark, sf_dir)
    nodes = splits.as_nodes(splits.grow(rows, FEATURES, 2, SCALE2))
    fitted = rows.select("l_returnflag", F.array(*FEATURES).alias("x")).join(F.broadcast(nodes)).select("l_returnflag", bases.tree_value(F.col("nodes"), F.col("x")).alias("fitted"))  # one row
    return tidy(fitted.groupBy("l_returnflag", "fitted").agg(F.count("*").alias("n")))


# ---- moves of fixed trees -------------------------------------------------------------------------------------------

MOVES = TreePrior(min_samples_leaf=10)
#: tree, node: depth, leaves of the tree, twigs after growing there (0 for inner nodes), whether a twig, twigs of the tree.
_SHAPE = "h AS (SELECT * FROM (VALUES " + ", ".join(map(str, [
    (0, 1, 1, 3, 0, 1, 1), (0, 2, 2, 3, 1, 0, 1), (0, 3, 2, 3, 1, 0, 1), (0, 4, 1, 3, 2, 0, 1), (1, 0, 0, 1, 1, 0, 0),
    (2, 1, 1, 4, 2, 0, 1), (2, 3, 2, 4, 2, 0, 1), (2, 4, 2, 4, 0, 1, 1), (2, 5, 3, 4, 1, 0, 1), (2, 6, 3, 4, 1, 0, 1), (3, 0, 0, 2, 0, 1, 1), (3, 1, 1, 2, 1, 0, 1), (3, 2, 1, 2, 1, 0, 1),
])) + ") h(tree, node, depth, leaves, after, twig, twigs))"
_PLACED = """o AS (SELECT e.*, 0 AS tree, CASE WHEN l_quantity <= 25 THEN CASE WHEN l_discount <= 0.05 THEN 2 ELSE 3 END ELSE 4 END AS node FROM e
  UNION ALL SELECT e.*, 1, 0 FROM e
  UNION ALL SELECT e.*, 2, CASE WHEN l_quantity <= 10 THEN 1 WHEN l_tax <= 0.04 THEN 3 WHEN l_discount <= 0.02 THEN 5 ELSE 6 END FROM e
  UNION ALL SELECT e.*, 3, CASE WHEN l_quantity <= 25 THEN 1 ELSE 2 END FROM e)"""


def fixed_trees(spark: SparkSession) -> DataFrame:
    """The trees whose moves are rated; the lines they meet are the table's."""
    trees = [
        F.array(node(0, 25.0, 1, 4, 0.0), node(1, 0.05, 2, 3, 0.0), leaf(1.0), leaf(2.0), leaf(3.0)),
        F.array(leaf(0.5)),
        F.array(node(0, 10.0, 1, 2, 0.0), leaf(1.0), node(2, 0.04, 3, 4, 0.0), leaf(2.0), node(1, 0.02, 5, 6, 0.0), leaf(3.0), leaf(4.0)),
        F.array(node(0, 25.0, 1, 2, 0.0), leaf(1.0), leaf(2.0)),
    ]
    return spark.range(1).select(F.posexplode(F.array(*trees)).alias("tree", "nodes"))


def split_prior(depth: str) -> str:
    a, b = MOVES.alpha, MOVES.beta
    here, below = f"({a} * power(1 + {depth}, -{b}))", f"({a} * power(2 + {depth}, -{b}))"
    return f"(ln({here}) + 2 * ln(1 - {below}) - ln(1 - {here}))"


_GROWN = cuts_of("o", "tree, node", MOVES.min_samples_leaf, "c")


@query(sql(f"{_LINES}, {_PLACED}, {_SHAPE}, {_GROWN}, x AS (SELECT tree, node, feature, cut, gain + {split_prior('depth')} + CASE WHEN leaves = 1 THEN ln(0.5) ELSE 0 END + ln(leaves) - ln(after) AS ratio FROM c JOIN h USING (tree, node))", "", "tree node feature", "cut ratio", digits=4))
def q_grow_ratios(spark, sf_dir):
    """The log acceptance of every split of every leaf of four trees, over all lines."""
    return tidy(moves.grow_ratios(lines(spark, sf_dir), fixed_trees(spark), [], FEATURES, SCALE2, MOVES), 4)


@query(sql(f"""{_LINES}, {_PLACED}, {_SHAPE}, g AS (SELECT tree, node, sum(w) AS p, sum(w * r) AS q FROM o GROUP BY ALL),
t AS (SELECT h.*, a.p AS pl, a.q AS ql, b.p AS pr, b.q AS qr FROM h JOIN g a ON a.tree = h.tree AND a.node = h.node + 1 JOIN g b ON b.tree = h.tree AND b.node = h.node + 2 WHERE twig = 1),
x AS (SELECT tree, node, -({evidence('pl', 'ql')} + {evidence('pr', 'qr')} - {evidence('(pl + pr)', 'ql + qr')} + {split_prior('depth')} + CASE WHEN node = 0 THEN ln(0.5) ELSE 0 END + ln(leaves - 1) - ln(twigs)) AS ratio FROM t)""", "", "tree node", "ratio", digits=4))  # fmt: skip
def q_prune_ratios(spark, sf_dir):
    """The log acceptance of taking back every twig of four trees, over all lines."""
    return tidy(moves.prune_ratios(lines(spark, sf_dir), fixed_trees(spark), [], FEATURES, SCALE2, MOVES), 4)
