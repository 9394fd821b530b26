"""Diagnostics of Markov chains held as rows (keys..., chain, draw, value)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomcast.operators.order_stats import with_facts
from loomcast.operators.ranges import Ranges

FLAT = 1e-12


def autocorrelation(chains: DataFrame, lags: Sequence[int], by: Sequence[str] = ("chain",), spread: bool = False) -> DataFrame:
    """by, lag, rho: mean of products at that distance (over n - lag pairs) by the variance; 0 for short or flat chains.

    Spread, a chain may be of any length: moments come from one aggregation, lags from range partitions with a halo.
    """
    if spread:
        facts = chains.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("_m"), F.var_pop("value").alias("v"))
        rows = Ranges(chains.select(*by, "draw", "value"), by, ["draw"]).ranked("_t", {f"l{k}": ("value", k) for k in lags})
        rows = with_facts(rows, facts, by).withColumn("_d", F.col("value") - F.col("_m"))
        wide = rows.groupBy(*by).agg(F.first("n").alias("n"), F.first("v").alias("v"), *(F.avg(F.col("_d") * (F.col(f"l{k}") - F.col("_m"))).alias(f"m{k}") for k in lags))
        return _rho(wide, lags, by)
    w = Window.partitionBy(*by)
    ordered = w.orderBy("draw")
    rows = chains.select(*by, "draw", (F.col("value") - F.avg("value").over(w)).alias("d"), F.var_pop("value").over(w).alias("v"))
    aggs = [F.avg(F.col("d") * F.col(f"l{k}")).alias(f"m{k}") for k in lags]
    wide = rows.select("*", *(F.lead("d", k).over(ordered).alias(f"l{k}") for k in lags)).groupBy(*by).agg(F.count("*").alias("n"), F.first("v").alias("v"), *aggs)
    return _rho(wide, lags, by)


def _rho(wide: DataFrame, lags: Sequence[int], by: Sequence[str]) -> DataFrame:
    """by, lag, rho of rows with n, v and m<lag>, the mean product at that lag."""
    long = wide.select(*by, "n", "v", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"m{k}").alias("m")) for k in lags))).alias("e")).select(*by, "n", "v", "e.*")
    rho = F.when((F.col("n") <= F.col("lag")) | (F.col("v") < FLAT), 0.0).otherwise(F.col("m") / F.col("v"))
    return long.select(*by, "lag", rho.alias("rho"))


def lagged_products(chains: DataFrame, most: int, by: Sequence[str]) -> DataFrame:
    """by, lag, s, c: sums and numbers of the products of centred values that lie 1 to `most` draws apart.

    Each chain is sorted by draw and read in batches, of which only the last `most` values are kept for the next.
    """
    mean = chains.groupBy(*by).agg(F.avg("value").alias("_m"))
    rows = chains.join(mean, list(by)).select(*by, F.xxhash64(*by).alias("_g"), "draw", (F.col("value") - F.col("_m")).alias("_d"))
    schema = T.StructType([*(chains.schema[c] for c in by), T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("c", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, tail = None, np.empty(0)
        for batch in batches:
            g, d = batch.column("_g").to_numpy(), batch.column("_d").to_numpy()
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][: len(g)])
            sums, counts = [], []
            for start, stop in zip(starts, np.r_[starts[1:], len(g)]):
                tail = tail if g[start] == chain else tail[:0]
                x, chain = np.r_[tail, d[start:stop]], g[start]
                firsts = [max(len(tail), k) for k in range(1, most + 1)]
                sums.append([float(x[f:] @ x[f - k : len(x) - k]) if f < len(x) else 0.0 for k, f in enumerate(firsts, 1)])
                counts.append([max(0, len(x) - f) for f in firsts])
                tail = x[-most:]
            keys = [batch.column(c).take(pa.array(starts)) for c in by]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(sums, arrow.field("s").type), pa.array(counts, arrow.field("c").type)], schema=arrow)

    parts = rows.repartition(*by).sortWithinPartitions(*by, "draw").mapInArrow(run, schema)
    each = parts.select(*by, F.posexplode(F.arrays_zip("s", "c")).alias("k", "p"))
    return each.groupBy(*by, (F.col("k") + 1).alias("lag")).agg(F.sum("p.s").alias("s"), F.sum("p.c").alias("c"))


def effective_size(chains: DataFrame, by: Sequence[str] = ("chain",), most: int = 100) -> DataFrame:
    """by, ess: n / (1 + 2 sum of rho), rho taken in pairs up to the first pair with a negative sum, between 1 and n.

    Lags run to min(n - 1, most) - 1.  A chain of any length is read once, in order; no chain gathers in an array.
    """
    n = chains.groupBy(*by).agg(F.count("*").alias("n"), F.var_pop("value").alias("v"))
    top = F.least(F.col("n") - 1, F.lit(most)) - 1
    rho = F.when(F.col("v") < FLAT, 0.0).otherwise(F.col("s") / F.col("c") / F.col("v"))
    lags = lagged_products(chains, most - 1, by).join(n, list(by)).where(F.col("lag") <= top).select(*by, "lag", rho.alias("rho"))
    pairs = lags.groupBy(*by, F.floor((F.col("lag") - 1) / 2).alias("j")).agg(F.sum("rho").alias("p"), F.count("*").alias("k")).where("k = 2")
    ordered = Window.partitionBy(*by).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumn("gone", F.max((F.col("p") < 0).cast("int")).over(ordered))
    sums = n.join(pairs.groupBy(*by).agg(F.sum(F.when(F.col("gone") == 0, F.col("p"))).alias("total")), list(by), "left")
    size = F.col("n").cast("double")
    ess = F.when(F.col("n") <= 2, size).otherwise(F.greatest(F.lit(1.0), F.least(size, size / (1.0 + 2.0 * F.coalesce("total", F.lit(0.0))))))
    return sums.select(*by, ess.alias("ess"))


def rhat(chains: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, rhat: the Gelman-Rubin statistic of whole chains; 1 where they are flat.  Groups of one chain stop the query."""
    each = chains.groupBy(*by, "chain").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("s"))
    agg = each.groupBy(*by).agg(F.count("*").alias("c"), F.var_samp("m").alias("vm"), F.avg("v").alias("w"), F.first("s").alias("s"))
    ratio = F.sqrt(((F.col("s") - 1) / F.col("s") * F.col("w") + F.col("vm")) / F.col("w"))
    value = F.when(F.col("c") < 2, F.raise_error(F.lit("R-hat needs at least two chains")).cast("double")).when(F.col("w") < FLAT, 1.0).otherwise(ratio)
    return agg.select(*by, value.alias("rhat"))


def acf_band(chains: DataFrame, by: Sequence[str] = ("chain",)) -> DataFrame:
    """by, lower, upper: where sample autocorrelations of white noise stay, +-2 / sqrt(n)."""
    return chains.groupBy(*by).agg((-2.0 / F.sqrt(F.count("*"))).alias("lower"), (2.0 / F.sqrt(F.count("*"))).alias("upper"))
