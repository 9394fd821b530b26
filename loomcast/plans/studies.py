"""Simulation studies: series with known parts are fitted and forecast, and the results are scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.operators import interpret, metrics
from loomcast.plans.model import SeriesModel
from loomcast.sources import synthetic

# How the six processes are fitted.
SETTINGS: dict[int, dict] = {
    1: {"periods": [(12, 3)], "lags": (1,)},
    2: {"periods": [(12, 3), (7, 2)], "lags": (1, 2), "errors": "sv"},
    3: {"periods": [(12, 3)], "lags": (1,), "exog": ("x",)},
    4: {"periods": [(4, 1)], "lags": ()},
    5: {"periods": [(12, 3)], "lags": (1,), "exog": ("x",)},
    6: {"periods": [(12, 3)], "lags": (1,), "exog": ("x",)},
}


def recovery(spark: SparkSession, trials: int = 100, horizon: int = 20, level: float = 0.9, schedule: tuple[int, int, int] = (10, 150, 300)) -> DataFrame:
    """process, component (or forecast) and its scores, each the mean over the trials of the process.

    The last rows of each series are held out for the forecast scores; the others are fitted, and their components
    compared with the true ones.  All trials of a process are one panel.
    """
    out = None
    gfr, burnin, kept = schedule
    for kind, settings in SETTINGS.items():
        rows = synthetic.trials(spark, kind, trials)
        train = rows.where(F.col("t") < synthetic.LENGTHS[kind] - horizon)
        ahead = rows.where(F.col("t") >= synthetic.LENGTHS[kind] - horizon).withColumn("h", (F.col("t") - (synthetic.LENGTHS[kind] - horizon)).cast("int"))
        model = SeriesModel(num_gfr=gfr, num_burnin=burnin, num_mcmc=kept, **settings).fit(train, time=None, order="t")
        samples = model.forecast(horizon, ahead.select("unique_id", "h", "x")).samples
        scored = samples.join(ahead.select("unique_id", "h", F.col("y").alias("actual")), ["unique_id", "h"])
        scores = metrics.evaluate(scored, train, ["unique_id"], level)
        names = [c for c in scores.columns if c != "unique_id"]
        drawn = interpret.unscaled(model.component_draws(), model.run.state)
        parts = metrics.component_fidelity(drawn, train.select("unique_id", "t", *interpret.COMPONENTS), ["unique_id"], level)
        whole = metrics.trial_summary(scores.withColumn("component", F.lit("forecast")), ["component"], names)
        each = metrics.trial_summary(parts, ["component"], ["rmse", "coverage"])
        absent = [c for c in names if c not in each.columns]
        one = whole.unionByName(each.select("*", *(F.lit(None).cast("double").alias(c) for c in absent))).select(F.lit(kind).alias("process"), "component", *names)
        out = one if out is None else out.union(one)
    return out
