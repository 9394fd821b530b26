"""Design matrices as array columns: x_tr (trend), x_se (seasonal) and x_ge (generic) on the rows of series.

What a design needs of its training series is a state, one row for each series, made by one aggregation.  Designs of
training rows and of future rows are projections over rows joined with that state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.config import ModelConfig
from loomcast.functions import bases
from loomcast.operators.ranges import Ranges
from loomcast.sources.series import moved


def _empty() -> Column:
    return F.lit(None).cast("array<double>")


def _seasonal_parts(config: ModelConfig, levels: Column | None) -> Column:
    """Harmonics and calendar columns of a row with t and ds, before centring."""
    s = config.seasonal
    parts = [bases.fourier(F.col("t"), s.periods)] if s.periods else []
    parts += [bases.one_hot(bases.CALENDAR[c](F.col("ds")), F.element_at(levels, F.lit(c))) for c in s.calendar]
    return F.concat(*parts) if parts else F.array().cast("array<double>")


def feature_state(series: DataFrame, config: ModelConfig) -> DataFrame:
    """One row for each series: n, t_scale, knots, calendar_levels, seasonal_means, max_lag, y_mean, y_std and the last rows.

    Levels, means, y_mean and y_std (of the population; 1 if it is 0) are those of the rows after the first max_lag.
    Series with no row left stop the query with their name.
    """
    cfg, lag = config, config.generic.max_lag
    kept = F.col("t") >= lag
    levels = [F.sort_array(F.collect_set(F.when(kept, bases.CALENDAR[c](F.col("ds"))))).alias(f"lv_{c}") for c in cfg.seasonal.calendar]
    grouped = series.groupBy("unique_id").agg(
        F.count("*").alias("n"),
        F.avg(F.when(kept, F.col("y"))).alias("y_mean"),
        F.stddev_pop(F.when(kept, F.col("y"))).alias("sd"),
        F.max("ds").alias("last_ds"),
        *levels,
    )
    n = F.when(F.col("n") > lag, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("no rows left after the lags in series "), "unique_id")).cast("long"))
    grouped = grouped.withColumn("n", n).withColumn("t_scale", bases.scale(F.col("n")))
    lo, hi = F.lit(float(lag)) / F.col("t_scale"), (F.col("n") - 1) / F.col("t_scale")
    spline = cfg.trend.mode == "spline"
    calendar = F.create_map(*(x for c in cfg.seasonal.calendar for x in (F.lit(c), F.col(f"lv_{c}")))) if cfg.seasonal.calendar else F.create_map().cast("map<string,array<int>>")
    state = grouped.select(
        "unique_id",
        "n",
        "t_scale",
        (bases.knots(lo, hi, cfg.trend.n_knots, cfg.trend.spline_degree) if spline else _empty()).alias("knots"),
        calendar.alias("calendar_levels"),
        F.lit(lag).alias("max_lag"),
        "y_mean",
        F.coalesce(F.when(F.col("sd") > 0, F.col("sd")), F.lit(1.0)).alias("y_std"),
        "last_ds",
    )
    if not (cfg.has_seasonal and cfg.seasonal.sum_to_zero):
        return state.withColumn("seasonal_means", _empty())
    rows = series.where(kept).join(state.select("unique_id", "calendar_levels"), "unique_id")
    each = rows.select("unique_id", F.posexplode(_seasonal_parts(cfg, F.col("calendar_levels"))).alias("pos", "val"))
    means = each.groupBy("unique_id", "pos").agg(F.avg("val").alias("m")).groupBy("unique_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("seasonal_means"))
    return state.join(means, "unique_id", "left")


def _trend(config: ModelConfig, u: Column) -> Column:
    t = config.trend
    if t.mode == "tree":
        return bases.tree_trend(u)
    if t.mode == "spline":
        return bases.let(u, lambda v: bases.spline_trend(v, F.col("knots"), t.n_knots, t.spline_degree))
    return bases.polynomial(u, 1 if t.mode == "tvp" else t.degree)


def _seasonal(config: ModelConfig) -> Column:
    raw = _seasonal_parts(config, F.col("calendar_levels"))
    return bases.centred(raw, F.col("seasonal_means")) if config.has_seasonal and config.seasonal.sum_to_zero else raw


def design(series: DataFrame, state: DataFrame, config: ModelConfig, spread: bool = False) -> DataFrame:
    """unique_id, t, ds, y, z, x_tr, x_se, x_ge of the training rows after the first max_lag; z is y standardised.

    spread takes lags from range partitions with a halo of max_lag rows, so that a series may be of any length.
    """
    check_disjoint(config)
    w = Window.partitionBy("unique_id").orderBy("t")
    back = sorted({k for k in config.generic.lags if k > 0})
    if spread and back:
        series = Ranges(series, ["unique_id"], ["t"]).ranked("_t", {f"_lag{k}": ("y", k) for k in back})
    lags = [(F.col(f"_lag{k}") if spread else F.lag("y", k).over(w)) if k > 0 else F.col("y") for k in config.generic.lags]
    generic = bases.doubles(*lags, *(F.col(f"x_{c}") for c in config.generic.covariates)) if config.has_generic else F.array().cast("array<double>")
    rows = series.withColumn("x_ge", generic).where(F.col("t") >= config.generic.max_lag)
    joined = rows.join(state, "unique_id")
    return joined.select(
        "unique_id", "t", "ds", "y",
        ((F.col("y") - F.col("y_mean")) / F.col("y_std")).alias("z"),
        _trend(config, F.col("t") / F.col("t_scale")).alias("x_tr"),
        _seasonal(config).alias("x_se"),
        "x_ge",
    )


def future_times(state: DataFrame, horizon: int, steps: DataFrame | None = None) -> DataFrame:
    """state with h (0 .. horizon - 1), t and ds of the rows to come; ds is null where no step (frequency) is known."""
    rows = state.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))).withColumn("t", (F.col("n") + F.col("h")).cast("int"))
    if steps is None:
        return rows.withColumn("ds", F.lit(None).cast("timestamp"))
    joined = rows.join(steps, "unique_id", "left")
    return joined.withColumn("ds", moved(F.col("last_ds"), (F.col("h") + 1).cast("int"), F.col("unit"), F.col("months"), F.col("seconds"))).drop("unit", "months", "seconds")


def future_design(state: DataFrame, config: ModelConfig, horizon: int, steps: DataFrame | None = None, times: DataFrame | None = None) -> DataFrame:
    """unique_id, h, t, ds, x_tr, x_se of the rows to come, by the state of the training rows.

    times (unique_id, h, ds) gives times where no step can be told.  Calendar features without times are an error.
    """
    rows = future_times(state, horizon, steps)
    if times is not None:
        rows = rows.drop("ds").join(times.select("unique_id", "h", "ds"), ["unique_id", "h"], "left")
    elif config.seasonal.calendar and steps is None:
        raise ValueError("calendar features need future times")
    return rows.select("unique_id", "h", "t", "ds", _trend(config, F.col("t") / F.col("t_scale")).alias("x_tr"), _seasonal(config).alias("x_se"))


def feature_names(state: DataFrame, config: ModelConfig) -> DataFrame:
    """unique_id, block, pos, name, penalised of every design column."""
    trend = [F.struct(F.lit(n).alias("name"), F.lit(p).alias("penalised")) for n, p in zip(config.trend.names(), config.trend.penalised())]
    plain = lambda name: F.struct(name.alias("name"), F.lit(False).alias("penalised"))

    def level_named(field: str) -> Callable[[Column], Column]:
        return lambda v: plain(F.concat(F.lit(f"{field}_"), v.cast("string")))

    seasonal = [F.array(*(plain(F.lit(n)) for n in bases.fourier_names(config.seasonal.periods)))] if config.seasonal.periods else []
    for c in config.seasonal.calendar:
        levels = F.element_at("calendar_levels", F.lit(c))
        used = F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0)))
        seasonal.append(F.transform(used, level_named(c)))
    generic = [plain(F.lit(n)) for n in config.generic.names()]
    blocks = [("trend", F.array(*trend))]
    blocks += [("seasonal", F.concat(*seasonal))] if seasonal else []
    blocks += [("generic", F.array(*generic))] if generic else []
    out = None
    for block, names in blocks:
        one = state.select("unique_id", F.lit(block).alias("block"), F.posexplode(names).alias("pos", "f")).select("unique_id", "block", "pos", "f.name", "f.penalised")
        out = one if out is None else out.union(one)
    return out


def check_disjoint(config: ModelConfig) -> None:
    """Generic features are lags and covariates only, so that blocks don't share columns."""
    generic = set(config.generic.names())
    shared = generic & ({*config.trend.names()} | {*bases.fourier_names(config.seasonal.periods)})
    assert not shared and all(n.startswith(("y_lag", "x_")) for n in generic), f"blocks share features: {sorted(shared)}"


def future_covariates(future: DataFrame, config: ModelConfig, horizon: int) -> DataFrame:
    """unique_id, h and covs (an array in the order of the generic design) of future (unique_id, h, covariates)."""
    names = config.generic.covariates
    missing = [c for c in dict.fromkeys(names) if c not in future.columns]
    if missing:
        raise ValueError(f"missing future covariates: {', '.join(missing)}")
    return future.where(F.col("h").between(0, horizon - 1)).select("unique_id", "h", bases.doubles(*(F.col(c) for c in names)).alias("covs"))


def future_row(state: DataFrame, history: DataFrame, config: ModelConfig, h: int, future: DataFrame | None = None, steps: DataFrame | None = None, times: DataFrame | None = None) -> DataFrame:
    """The whole design of step h alone, with lags from history (unique_id, t, y), which must reach to the step before."""
    base = future_design(state, config, h + 1, steps, times).where(F.col("h") == h)
    if not config.has_generic:
        return base.withColumn("x_ge", F.array().cast("array<double>"))
    lags = sorted(set(config.generic.lags))
    rows = base
    if lags:
        wanted = base.select("unique_id", "t", F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn("at", F.col("t") - F.col("lag"))
        past = history.select("unique_id", F.col("t").alias("at"), "y")
        wide = wanted.join(past, ["unique_id", "at"], "left").groupBy("unique_id").agg(*(F.max(F.when(F.col("lag") == k, F.col("y"))).alias(f"lag{k}") for k in lags))
        rows = rows.join(wide, "unique_id", "left")
    if config.generic.covariates:
        if future is None:
            raise ValueError("covariates need future values")
        rows = rows.join(future_covariates(future, config, h + 1), ["unique_id", "h"], "left")
    parts = ([bases.doubles(*(F.col(f"lag{k}") for k in config.generic.lags))] if lags else []) + ([F.col("covs")] if config.generic.covariates else [])
    return rows.select(*base.columns, F.concat(*parts).alias("x_ge"))
