"""Posterior predictive simulation, and its summaries."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomcast.config import ModelConfig
from loomcast.functions import bases
from loomcast.operators.design import future_covariates
from loomcast.operators.gibbs import walk_variance
from loomcast.operators.interpret import COMPONENTS, bands, long_components
from loomcast.operators.metrics import quantiles, tails
from loomcast.operators.trees import Forests


def _in_order(value: str) -> Column:
    """The values of a group by h, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct("h", value))), lambda e: e[value])


def _rows(column: pa.Array, n: int, *shape: int) -> np.ndarray:
    """An array column (of arrays) of equal lengths as a numpy array with n rows."""
    while not pa.types.is_floating(column.type):
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).reshape(n, *shape)


def simulate(
    posterior: DataFrame, state: DataFrame, future: DataFrame, history: DataFrame, config: ModelConfig, horizon: int, covariates: DataFrame | None = None, call: int = 0
) -> DataFrame:
    """unique_id, chain, draw, h, t, sample, trend, seasonal, generic on the scale of y, for h in 0 .. horizon - 1.

    future has the designs to come (unique_id, h, x_tr, x_se), history the training rows (unique_id, t, y), covariates the
    future values (unique_id, h, names).  Trend and seasonal parts of the whole horizon are Column expressions; only the
    recursion over lags, whose inputs are earlier samples, is a map over draws.  The noise of a draw depends on seed,
    series, chain, draw and call only; another call gives other noise.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    lags, names = list(config.generic.lags), config.generic.covariates
    if names:
        if covariates is None:
            raise ValueError(f"missing future covariates: {', '.join(dict.fromkeys(names))}")
        covs = future_covariates(covariates, config, horizon)
        absent = future.select("unique_id", "h").join(covs, ["unique_id", "h"], "left_anti").head(1)
        if absent:
            raise ValueError(f"missing future covariates of series {absent[0]['unique_id']} at step {absent[0]['h']}")
    else:
        covs = future.select("unique_id", "h", F.array().cast("array<double>").alias("covs"))
    packed = future.groupBy("unique_id").agg(_in_order("x_tr").alias("f_tr"), _in_order("x_se").alias("f_se"))
    packed = packed.join(covs.groupBy("unique_id").agg(_in_order("covs").alias("f_covs")), "unique_id")
    last = history.join(state.select("unique_id", "n"), "unique_id").where(F.col("t") >= F.col("n") - max(config.generic.max_lag, 1))
    packed = packed.join(last.groupBy("unique_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda e: e["y"]).alias("tail")), "unique_id")
    packed = packed.join(state.select("unique_id", "n", "y_mean", "y_std", "max_lag"), "unique_id")

    mode = config.trend.mode
    zeros = F.array_repeat(F.lit(0.0), horizon)
    drawn = posterior.where("error IS NULL").join(packed, "unique_id")
    has = set(posterior.columns)
    col = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind)
    if mode == "tree":
        trend = F.transform("f_tr", lambda x: bases.forest_value(F.col("trend_trees"), x))
    elif mode == "tvp":
        trend = zeros  # a walk of its own, made with the other noise below
    else:
        trend = F.transform("f_tr", lambda x: bases.dot(x, F.col("beta")))
    seasonal = F.transform("f_se", lambda x: bases.forest_value(F.col("seasonal_trees"), x)) if config.has_seasonal else zeros
    ready = drawn.select(
        "unique_id", "chain", "draw", "n", "y_mean", "y_std", "max_lag", "tail", "f_covs", "f_tr", "beta", "sigma2",
        col("h_last", "double").alias("h_last"), col("sv_mu", "double").alias("sv_mu"), trend.alias("trend"), seasonal.alias("seasonal"),
        (F.col("generic_trees") if config.has_generic else F.array().cast(f"array<array<{bases.NODE}>>")).alias("trees"),
    )
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField("unique_id", T.StringType()), T.StructField("chain", T.IntegerType()), T.StructField("draw", T.IntegerType()), T.StructField("n", T.LongType()), *(T.StructField(c, doubles) for c in ("sample", *COMPONENTS))])
    arrow = to_arrow_schema(schema)

    def paths_of(b: pa.RecordBatch) -> pa.RecordBatch:
        """The paths of a batch of draws, which take each step together."""
        n = b.num_rows
        ids = [b.column(c).to_pylist() for c in ("unique_id", "chain", "draw")]
        rngs = [np.random.default_rng(np.random.SeedSequence([config.mcmc.seed, zlib.crc32(u.encode()), chain, draw, 1 + call])) for u, chain, draw in zip(*ids)]
        mean, sd = b.column("y_mean").to_numpy()[:, None], b.column("y_std").to_numpy()[:, None]
        if mode == "tvp":
            f = _rows(b.column("f_tr"), n, horizon, 2)
            step = np.sqrt([walk_variance(k - lag, config.trend.coef_scale, config.trend.smoothing) for k, lag in zip(b.column("n").to_pylist(), b.column("max_lag").to_pylist())])
            walk = np.array([g.standard_normal((horizon, 2)) for g in rngs]) * step[:, None, None]
            trend = (f * (_rows(b.column("beta"), n, 1, 2) + np.cumsum(walk, axis=1))).sum(2)
        else:
            trend = _rows(b.column("trend"), n, horizon)
        if config.error.mode == "sv":
            h, mu = b.column("h_last").to_numpy(zero_copy_only=False), b.column("sv_mu").to_numpy(zero_copy_only=False)
            moved, noise = np.array([g.standard_normal(horizon) for g in rngs]), np.empty((n, horizon))
            for k in range(horizon):
                h = mu + config.error.sv_phi * (h - mu) + config.error.sv_sigma_h * moved[:, k]
                noise[:, k] = np.exp(h / 2.0)
        else:
            noise = np.sqrt(b.column("sigma2").to_numpy(zero_copy_only=False))[:, None]
        noise = noise * np.array([g.standard_normal(horizon) for g in rngs])
        seasonal = _rows(b.column("seasonal"), n, horizon)
        past, generic, out = _rows(b.column("tail"), n, -1), np.zeros((n, horizon)), np.empty((n, horizon))
        forests = Forests.of(b.column("trees")) if config.has_generic else None
        covs = _rows(b.column("f_covs"), n, horizon, len(names))
        for k in range(horizon):
            if forests is not None:
                x = [past[:, -lag] if lag > 0 else np.full(n, np.nan) for lag in lags]
                generic[:, k] = forests.values(np.column_stack([*x, covs[:, k]]))
            out[:, k] = mean[:, 0] + sd[:, 0] * (trend[:, k] + seasonal[:, k] + generic[:, k] + noise[:, k])
            past = np.column_stack([past[:, 1:], out[:, k]])
        ends = pa.array(np.arange(0, n * horizon + 1, horizon, dtype=np.int32))
        parts = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (out, mean + sd * trend, sd * seasonal, sd * generic)]
        return pa.RecordBatch.from_arrays([b.column(c) for c in ("unique_id", "chain", "draw", "n")] + parts, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield paths_of(batch.slice(at, 256))

    paths = ready.mapInArrow(run, schema)
    each = paths.select("unique_id", "chain", "draw", "n", F.posexplode(F.arrays_zip("sample", *COMPONENTS)).alias("h", "v"))
    return each.select("unique_id", "chain", "draw", "h", (F.col("n") + F.col("h")).cast("int").alias("t"), "v.*")


def noise_variance(config: ModelConfig, h: Column) -> Column:
    """The expected variance of the noise at step h (from 0) of a draw; that of a log-normal AR(1) for volatilities."""
    e = config.error
    if e.mode != "sv":
        return F.col("sigma2")
    steps = (h + 1).cast("double")
    spread = F.lit(e.sv_sigma_h**2) * ((1.0 - F.pow(F.lit(e.sv_phi**2), steps)) / (1.0 - e.sv_phi**2) if e.sv_phi**2 < 1.0 else steps)
    return F.exp(F.col("sv_mu") + F.pow(F.lit(e.sv_phi), steps) * (F.col("h_last") - F.col("sv_mu")) + spread / 2.0)


def moments(posterior: DataFrame, state: DataFrame, future: DataFrame, config: ModelConfig, covariates: DataFrame | None = None) -> DataFrame:
    """unique_id, h, t, mean and variance of the forecast, in closed form, for models whose generic block has no lags.

    Of each draw the parts are known, but for the drift of a walking trend, whose variance grows with the steps, and the
    noise; over draws, the variance is the mean of theirs and the variance of their means.  It is the variance of one path
    for each draw, which samples approach.  future is the design to come, covariates their future values.
    """
    if config.generic.lags:
        raise ValueError("lags feed samples back into the forest; such forecasts have no closed form")
    names = config.generic.covariates
    h, y_std = F.col("h"), F.col("y_std")
    rows = future.select("unique_id", "h", "t", "x_tr", "x_se")
    if names:
        if covariates is None:
            raise ValueError(f"missing future covariates: {', '.join(dict.fromkeys(names))}")
        given = covariates.select("unique_id", "h", bases.doubles(*(F.col(c) for c in names)).alias("covs"))
        rows = rows.join(given, ["unique_id", "h"], "left").withColumn("covs", F.coalesce("covs", F.raise_error(F.concat(F.lit("missing future covariates of series "), "unique_id")).cast("array<double>")))
    kept = [c for c in ("beta", "sigma2", "h_last", "sv_mu", "trend_trees", "seasonal_trees", "generic_trees") if c in posterior.columns]
    drawn = posterior.where("error IS NULL").select("unique_id", *kept).join(rows, "unique_id").join(state.select("unique_id", "n", "max_lag", "y_mean", "y_std"), "unique_id")
    parts = [bases.forest_value(F.col("trend_trees"), F.col("x_tr")) if config.trend.mode == "tree" else bases.dot(F.col("x_tr"), F.col("beta"))]
    parts += [bases.forest_value(F.col("seasonal_trees"), F.col("x_se"))] if config.has_seasonal else []
    parts += [bases.forest_value(F.col("generic_trees"), F.col("covs"))] if names else []
    whole = parts[0]
    for p in parts[1:]:
        whole = whole + p
    variance = noise_variance(config, h)
    if config.trend.mode == "tvp":
        step = F.greatest(F.lit(config.trend.coef_scale**2 * config.trend.smoothing) / (F.col("n") - F.col("max_lag")), F.lit(1e-6))
        variance = variance + step * (h + 1) * bases.dot(F.col("x_tr"), F.col("x_tr"))
    each = drawn.select("unique_id", "h", "t", (F.col("y_mean") + y_std * whole).alias("_m"), (y_std * y_std * variance).alias("_v"))
    return each.groupBy("unique_id", "h", "t").agg(F.avg("_m").alias("mean"), (F.avg("_v") + F.var_pop("_m")).alias("variance"))


def trend_mean(coefficients: DataFrame, state: DataFrame, future: DataFrame) -> DataFrame:
    """unique_id, h, t, mean: the forecast of a line with known coefficients b0, b1, on the scale of y."""
    joined = future.join(coefficients, "unique_id").join(state.select("unique_id", "y_mean", "y_std"), "unique_id")
    return joined.select("unique_id", "h", "t", (F.col("y_mean") + F.col("y_std") * bases.dot(F.col("x_tr"), F.array("b0", "b1"))).alias("mean"))


def mean(samples: DataFrame, value: str = "sample") -> DataFrame:
    return samples.groupBy("unique_id", "h", "t").agg(F.avg(value).alias("mean"))


def median(samples: DataFrame, value: str = "sample") -> DataFrame:
    return quantile(samples, 0.5, value).withColumnRenamed("quantile", "median")


def quantile(samples: DataFrame, prob: float, value: str = "sample") -> DataFrame:
    return samples.groupBy("unique_id", "h", "t").agg(quantiles(value, [prob])[0].alias("quantile"))


def interval(samples: DataFrame, level: float = 0.9, value: str = "sample", spread: bool = False) -> DataFrame:
    return bands(samples, ("unique_id", "h", "t"), value, level, spread).drop("mean")


def component_bands(samples: DataFrame, level: float = 0.9) -> DataFrame:
    """unique_id, component, h, t, mean, lower, upper."""
    return bands(long_components(samples, ("unique_id", "h", "t"), COMPONENTS), ("unique_id", "component", "h", "t"), level=level)


def wide(samples: DataFrame, times: DataFrame, model: str = "model", levels: Sequence[int] = (80, 90)) -> DataFrame:
    """unique_id, h, t, ds, <model>, and <model>-lo-L <model>-hi-L for each level in percent; ds is null where no step in time is known."""
    ends = [e for level in levels for e in tails(level / 100.0)]
    each = samples.groupBy("unique_id", "h", "t").agg(F.avg("sample").alias(model), *([quantiles("sample", ends).alias("_q")] if ends else []))
    known = times.select("unique_id", "h", "ds")
    columns = [c for k, level in enumerate(levels) for c in (F.col("_q")[2 * k].alias(f"{model}-lo-{level}"), F.col("_q")[2 * k + 1].alias(f"{model}-hi-{level}"))]
    return each.join(known, ["unique_id", "h"], "left").select("unique_id", "h", "t", "ds", F.col(model), *columns)
