"""Posterior draws of every series and chain of a panel, one row for each kept draw."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomcast.config import ModelConfig, TrendConfig
from loomcast.functions.bases import dot
from loomcast.operators import solve
from loomcast.operators.gibbs import Builder, blocks_of, run_chain, run_moments_chain, seed_for, trend_precision


def posterior_schema() -> T.StructType:
    doubles, node = T.ArrayType(T.DoubleType()), T.StructType([T.StructField("feat", T.IntegerType()), T.StructField("thresh", T.DoubleType()), T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()), T.StructField("value", T.DoubleType())])
    forest = T.ArrayType(T.ArrayType(node))
    kinds = [
        ("unique_id", T.StringType()), ("chain", T.IntegerType()), ("draw", T.IntegerType()), ("beta", doubles), ("sigma2", T.DoubleType()),
        ("h_last", T.DoubleType()), ("sv_mu", T.DoubleType()), ("sigma2_t", doubles), ("trend", doubles), ("seasonal", doubles), ("generic", doubles),
        ("trend_trees", forest), ("seasonal_trees", forest), ("generic_trees", forest), ("gap", T.DoubleType()), ("error", T.StringType()),
    ]
    return T.StructType([T.StructField(n, k) for n, k in kinds])


HELD = 64  # draws that a task holds before it hands them on


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow array of numbers, numpy arrays or forests (lists of lists of node tuples)."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    values = [[] if v is None else v for v in values]
    ends = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
    if not pa.types.is_list(kind.value_type):
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.asarray(v, float) for v in values]), kind.value_type), type=kind)
    trees = [t for v in values for t in v]
    nodes = np.array([n for t in trees for n in t], float).reshape(-1, 5)
    fields = list(kind.value_type.value_type)
    parts = [pa.array(nodes[:, k] if pa.types.is_floating(f.type) else nodes[:, k].astype(np.int32), f.type) for k, f in enumerate(fields)]
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, trees)]), pa.int32()), pa.StructArray.from_arrays(parts, fields=fields), type=kind.value_type)
    return pa.ListArray.from_arrays(ends, inner, type=kind)


def _batches(draws: Callable[[], Iterator[dict]], unique_id: str, chain: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The draws of a chain, HELD at a time; an error becomes a last row, so that a bad series doesn't end the others."""

    def batch(rows: list[dict]) -> pa.RecordBatch:
        rows = [{"unique_id": unique_id, "chain": chain, **r} for r in rows]
        return pa.RecordBatch.from_arrays([_column([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)

    held: list[dict] = []
    try:
        for d in draws():
            held.append(d)
            if len(held) == HELD:
                yield batch(held)
                held = []
    except (ValueError, ArithmeticError, IndexError, np.linalg.LinAlgError) as e:
        held.append({"draw": -1, "error": f"{type(e).__name__}: {e}"})
    if held:
        yield batch(held)


def posterior(design: DataFrame, config: ModelConfig, build: Builder = blocks_of) -> DataFrame:
    """Draws of the whole model: a grouped map over (series, chain), which draws the same however rows are partitioned.

    A chain that fails ends with a row with draw -1 and its error.  build makes the blocks of a chain (gibbs.Block); one
    of one's own can replace the trend, the seasonal or the generic block.
    """
    schema = posterior_schema()
    arrow = to_arrow_schema(schema)
    chains = design.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(config.mcmc.chains - 1)))).select("unique_id", "chain", "t", "z", "x_tr", "x_se", "x_ge")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unique_id, chain = key[0].as_py(), key[1].as_py()
        rows = pa.Table.from_batches(list(batches)).sort_by("t").combine_chunks()

        def draws() -> Iterator[dict]:
            x = [rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) for c in ("x_tr", "x_se", "x_ge")]
            return run_chain(rows["z"].to_numpy(), *x, config, seed_for(config.mcmc.seed, unique_id, chain), build)

        yield from _batches(draws, unique_id, chain, arrow)

    return chains.groupBy("unique_id", "chain").applyInArrow(run, schema)


def trend_moments(design: DataFrame, width: int) -> DataFrame:
    """unique_id, n, gram (upper triangle by rows), cross and zz: all that a conjugate trend alone depends on.

    One aggregation whose partial sums are made before the shuffle; a series may be of any length.
    """
    x = F.col("x_tr")
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = design.groupBy("unique_id").agg(
        F.count("*").alias("n"),
        *(F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i, j in pairs),
        *(F.sum(x[i] * F.col("z")).alias(f"c{i}") for i in range(width)),
        F.sum(F.col("z") * F.col("z")).alias("zz"),
    )
    return sums.select("unique_id", "n", F.array(*(f"g{i}_{j}" for i, j in pairs)).alias("gram"), F.array(*(f"c{i}" for i in range(width))).alias("cross"), "zz")


def moments_posterior(moments: DataFrame, config: ModelConfig) -> DataFrame:
    """Draws (unique_id, chain, draw, beta, sigma2, error) of a model with a linear or spline trend and nothing else."""
    if not config.trend.conjugate or config.has_seasonal or config.has_generic or config.error.mode != "homo":
        raise ValueError("sums are enough only for a conjugate trend with constant noise and no other block")
    penalised = np.array(config.trend.penalised())
    schema = T.StructType([f for f in posterior_schema() if f.name in ("unique_id", "chain", "draw", "beta", "sigma2", "error")])
    arrow = to_arrow_schema(schema)
    rows = moments.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(config.mcmc.chains - 1)))).repartition("unique_id", "chain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(len(penalised))
        for batch in batches:
            for r in batch.to_pylist():
                gram = np.zeros((len(penalised),) * 2)
                gram[upper] = r["gram"]
                gram = gram + np.triu(gram, 1).T
                rng = seed_for(config.mcmc.seed, r["unique_id"], r["chain"])
                draws = lambda: run_moments_chain(r["n"], gram, np.array(r["cross"]), r["zz"], penalised, config, rng)  # noqa: B023, E731
                yield from _batches(draws, r["unique_id"], r["chain"], arrow)

    return rows.mapInArrow(run, schema)


def ridge_line(moments: DataFrame, coef_scale: float = 10.0, sigma2: float = 1.0) -> DataFrame:
    """unique_id, b0, b1: the posterior mean of a line's coefficients at a fixed variance, solved as a Column expression."""
    prior = 1.0 / coef_scale**2
    g, c = F.col("gram"), F.col("cross")
    a, b, d = g[0] / sigma2 + prior, g[1] / sigma2, g[2] / sigma2 + prior
    u, v = c[0] / sigma2, c[1] / sigma2
    det = a * d - b * b
    return moments.select("unique_id", ((d * u - b * v) / det).alias("b0"), ((a * v - b * u) / det).alias("b1"))


def least_squares_variance(moments: DataFrame) -> DataFrame:
    """unique_id, sigma2: variance of the residuals of a least-squares line, at least 0.001."""
    g, c = F.col("gram"), F.col("cross")
    det = g[0] * g[2] - g[1] * g[1]
    b0, b1 = (g[2] * c[0] - g[1] * c[1]) / det, (g[0] * c[1] - g[1] * c[0]) / det
    rest = F.col("zz") - b0 * c[0] - b1 * c[1]
    return moments.select("unique_id", F.greatest(rest / F.col("n"), F.lit(1e-3)).alias("sigma2"))


def posterior_mean(design: DataFrame, trend: TrendConfig, sigma2: float = 1.0, by: Sequence[str] = ("unique_id",), x: str = "x_tr", target: str = "z") -> DataFrame:
    """by, n and beta: the posterior mean of a conjugate trend's coefficients at a fixed variance, of any width.

    The normal equations come from one aggregation over non-zero entries; the penalised system is solved by a Cholesky
    factor over arrays.  Nothing leaves the JVM.
    """
    if not trend.conjugate:
        raise ValueError(f"a {trend.mode} trend has no coefficients with a normal prior")
    width = len(trend.names())
    prior = trend_precision(np.array(trend.penalised()), trend.coef_scale, trend.smoothing)
    whole = F.concat(x, F.array(F.col(target), F.lit(1.0)))
    sums = solve.normal_equations(design, by, whole, width + 2)
    square = F.transform(F.slice("a", 1, width), lambda r: F.transform(F.slice(r, 1, width), lambda v: v / sigma2))
    cross = F.transform(F.slice("a", 1, width), lambda r: F.get(r, F.lit(width)) / sigma2)
    ready = sums.select(*by, F.get(F.get("a", F.lit(width + 1)), F.lit(width + 1)).cast("long").alias("n"), solve.plus(square, solve.matrix(prior)).alias("s"), cross.alias("c"))
    return ready.withColumn("low", solve.cholesky(F.col("s"))).select(*by, "n", solve.solved(F.col("low"), F.col("c")).alias("beta"))


def design_variance(design: DataFrame, width: int, by: Sequence[str] = ("unique_id",)) -> DataFrame:
    """by, n, rank and sigma2: the variance of what least squares on all columns (x_tr, x_se, x_ge) leaves of z, at least
    0.001; it places the prior of the noise.  `width` counts the columns of all three; designs may be rank-deficient."""
    whole = F.concat("x_tr", "x_se", "x_ge", F.array(F.col("z"), F.lit(1.0)))
    sums = solve.normal_equations(design, by, whole, width + 2)
    left = sums.select(*by, F.get(F.get("a", F.lit(width + 1)), F.lit(width + 1)).alias("n"), solve.swept(F.col("a"), width).alias("s"))
    at = lambda j: F.get(F.get("s.a", F.lit(width)), F.lit(j))
    variance = at(width) / F.col("n") - F.pow(at(width + 1) / F.col("n"), F.lit(2.0))
    return left.select(*by, F.col("n").cast("long").alias("n"), F.col("s.rank").alias("rank"), F.greatest(variance, F.lit(1e-3)).alias("sigma2"))


def trend_paths(posterior: DataFrame, design: DataFrame) -> DataFrame:
    """unique_id, chain, draw, t and trend (standardised) of conjugate draws, by a join and a dot product."""
    draws = posterior.where("error IS NULL").select("unique_id", "chain", "draw", "beta")
    return design.select("unique_id", "t", "x_tr").join(draws, "unique_id").select("unique_id", "chain", "draw", "t", dot(F.col("x_tr"), F.col("beta")).alias("trend"))


def failures(posterior: DataFrame) -> DataFrame:
    return posterior.where("error IS NOT NULL").select("unique_id", "chain", "error")


def leaf_evidence(rows: DataFrame, by: list[str], scale2: float, sigma2: float) -> DataFrame:
    """by and lml, the log evidence of the values of each leaf (column r), for a fixed variance."""
    a = 1.0 / scale2
    p, q = F.sum(F.lit(1.0 / sigma2)), F.sum(F.col("r") / sigma2)
    return rows.groupBy(*by).agg((0.5 * F.log(F.lit(a) / (a + p)) + 0.5 * q * q / (a + p)).alias("lml"))
