"""Order over range partitions against windows and buffers, with partitions smaller than groups, lags and ties."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomcast.operators import diagnostics, metrics, order_stats
from loomcast.operators.ranges import Ranges
from loomcast.sources import series as sources

SIZES = {0: 300, 1: 1, 2: 2, None: 40, 4: 1, 5: 7}


def listed(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = [(g, None if r.random() < 0.05 else r.randrange(50), float(r.randrange(1000)), r.random() < 0.5) for g, n in SIZES.items() for _ in range(n)]
    return spark.createDataFrame(data, "g int, o int, y double, t2 boolean").cache()


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("part", [1000, 30, 5])
def test_ranks_lags_and_running_sums(rows, by, part):
    ranges = Ranges(rows, by, ["o", "y", "t2"], part)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("o", "y", "t2")
    rank = (F.row_number().over(w) - 1).alias("t")
    back = {f"l{k}": ("y", k) for k in (1, 7, 40)}
    assert listed(ranges.ranked("t", back)) == listed(rows.select("*", rank, *(F.lag("y", k).over(w).alias(name) for name, (_, k) in back.items())))
    total = F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")
    assert listed(ranges.running({"s": F.col("y")})) == listed(rows.select("*", rank, total))


def test_equal_rows_are_spread_over_partitions(spark):
    same = spark.range(4000).select(F.lit("a").alias("g"), F.lit(None).cast("int").alias("o"))
    ranges = Ranges(same, ["g"], ["o"], 400)
    assert ranges.rows.groupBy("_part").count().agg(F.max("count")).first()[0] < 1000
    assert sorted(r.t for r in ranges.ranked().collect()) == list(range(4000))


def test_small_tables_don_t_get_a_partition_for_each_of_the_sessions(spark):
    assert len(Ranges(spark.range(5000).withColumn("g", F.lit(1)), ["g"], ["id"])._parts) == 2


def test_empty_tables_and_clashing_names(spark, rows):
    none = Ranges(rows.limit(0), ["g"], ["o"])
    assert none.ranked().count() == 0 and none.running({"s": F.col("y")}).count() == 0
    assert order_stats.summary(rows.limit(0), ["g"], "y", [0.5]).count() == 0
    named = rows.select("g", "o", F.col("y").alias("key"), F.lit(1).alias("n"), F.lit(2).alias("part"))
    assert listed(Ranges(named, ["g"], ["o", "key"], 30).ranked("t")) == listed(named.select("*", (F.row_number().over(Window.partitionBy("g").orderBy("o", "key")) - 1).alias("t")))


@pytest.mark.parametrize("part", [1000, 20])
def test_quantiles_and_differences(rows, part):
    probs = [0.0, 0.05, 0.3, 0.5, 0.999, 1.0]
    got = {r.g: (r.q, r.c) for r in order_stats.summary(rows, ["g"], "y", probs, {"c": order_stats.apart("y")}, part).collect()}
    values = rows.toPandas()
    for g, n in SIZES.items():
        y = values.loc[values.g.isna() if g is None else values.g == g, "y"].to_numpy()
        assert len(y) == n and got[g][0] == pytest.approx(np.quantile(y, probs)) and got[g][1] == pytest.approx(np.abs(y[:, None] - y).mean() / 2)


def test_nulls_have_no_rank(spark):
    one = spark.createDataFrame([("a", None), ("a", 3.0), ("b", None)], "g string, y double")
    assert [(r.g, r.q) for r in order_stats.summary(one, ["g"], "y", [0.5]).collect()] == [("a", [3.0])]


def test_spread_scores_are_the_others(rows, spark):
    r = np.random.default_rng(2)
    data = [(u, h, float(10 * h), float(v)) for u in ("a", "b") for h in range(3) for v in np.round(r.normal(10 * h, 3, 60), 1)]
    samples = spark.createDataFrame(data, "unique_id string, h int, actual double, sample double")
    train = spark.createDataFrame([(u, t, float(v)) for u in ("a", "b") for t, v in enumerate(r.normal(0, 1, 50))], "unique_id string, t int, y double")
    for by in (["unique_id"], []):
        one, two = (metrics.evaluate(samples, train, by, spread=s).toPandas().sort_values(by or "rmse") for s in (False, True))
        assert list(one.columns) == list(two.columns)
        assert np.allclose(one.select_dtypes("number"), two.select_dtypes("number"), rtol=1e-9)


@pytest.mark.parametrize("flat", [False, True])
def test_spread_autocorrelation(spark, flat):
    r = np.random.default_rng(3)
    chain = spark.createDataFrame([(c, d, 1.0 if flat else float(v)) for c in (0, 1) for d, v in enumerate(r.normal(0, 1, 200 if c else 3))], "chain int, draw int, value double")
    one, two = (diagnostics.autocorrelation(chain, (1, 2, 5), spread=s).toPandas().sort_values(["chain", "lag"]) for s in (False, True))
    assert np.allclose(one["rho"], two["rho"])


def test_spread_series(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(f"s{r.randrange(3)}", r.randrange(40), float(r.randrange(9))) for _ in range(200)], "unique_id string, o int, y double")
    assert listed(sources.series(df, time=None, order="o", spread=True)) == listed(sources.series(df, time=None, order="o"))
