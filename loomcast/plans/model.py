"""The estimator: fits every series of a panel and answers with DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast import config as settings
from loomcast.operators import design as designs
from loomcast.operators import fit as fits
from loomcast.operators import forecast as forecasts
from loomcast.operators import interpret
from loomcast.sources import artifacts
from loomcast.sources import series as sources


@dataclass(frozen=True)
class Forecast:
    """samples: unique_id, chain, draw, h, t, sample, trend, seasonal, generic on the scale of the target."""

    samples: DataFrame

    def mean(self) -> DataFrame:
        return forecasts.mean(self.samples)

    def median(self) -> DataFrame:
        return forecasts.median(self.samples)

    def quantile(self, prob: float) -> DataFrame:
        return forecasts.quantile(self.samples, prob)

    def interval(self, level: float = 0.9) -> DataFrame:
        return forecasts.interval(self.samples, level)

    def component_mean(self, component: str) -> DataFrame:
        return forecasts.mean(self.samples, component)

    def component_interval(self, component: str, level: float = 0.9) -> DataFrame:
        return forecasts.interval(self.samples, level, component)

    def component_bands(self, level: float = 0.9) -> DataFrame:
        return forecasts.component_bands(self.samples, level)


class SeriesModel:
    """Trend + seasonality + generic part + noise, for one series or many at once.

    Settings come as a ModelConfig or as the flat arguments of make_config, not both.
    """

    def __init__(self, config: settings.ModelConfig | None = None, **flat: object) -> None:
        if config is not None and flat:
            raise ValueError("give a config or flat arguments, not both")
        self.config = config or settings.make_config(**flat)
        self._run: artifacts.Run | None = None
        self._calls = 0

    @property
    def run(self) -> artifacts.Run:
        if self._run is None:
            raise RuntimeError("the model isn't fitted")
        return self._run

    def fit(self, df: DataFrame, target: str = "y", time: str | None = "ds", unique_id: str | None = "unique_id", order: str | None = None, path: str | None = None) -> SeriesModel:
        """Fit every series of df.  With a path the run is written there and read back; else it is kept in Spark's cache,
        from which lost parts are drawn again alike."""
        cfg = self.config
        names = dict.fromkeys(cfg.generic.covariates)
        if cfg.seasonal.calendar and time is None:
            raise ValueError("calendar features need a time column")
        rows = sources.series(df, target, time, unique_id, tuple(names), order=order)
        state = designs.feature_state(rows, cfg).persist()
        draws = fits.posterior(designs.design(rows, state, cfg), cfg)
        run = artifacts.Run(cfg, draws, state, rows)
        if path is None:
            self._run = artifacts.Run(cfg, draws.persist(), state, rows)
        else:
            artifacts.save(run, path)
            self._run = artifacts.load(df.sparkSession, path)
        return self

    def release(self) -> None:
        """Free what fit has kept in Spark's cache; the model's frames are then made anew when used."""
        self.run.posterior.unpersist()
        self.run.state.unpersist()

    def fit_single(self, df: DataFrame, unique_id: str = "unique_id", **more: object) -> SeriesModel:
        """As fit, but more than one series is an error."""
        return self.fit(sources.single(df, unique_id), unique_id=unique_id, **more)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        artifacts.save(self.run, path, mode)

    @classmethod
    def load(cls, spark: SparkSession, path: str, series: Sequence[str] | None = None) -> SeriesModel:
        """A saved model, with the runs of some series only if they are given; their files alone are then read."""
        run = artifacts.load(spark, path, series)
        model = cls(run.config)
        model._run = run
        return model

    def failures(self) -> DataFrame:
        return fits.failures(self.run.posterior)

    def _future(self, horizon: int, times: DataFrame | None) -> DataFrame:
        run = self.run
        return designs.future_design(run.state, run.config, horizon, None if times is not None else sources.frequency(run.series), times)

    def forecast(self, horizon: int, covariates: DataFrame | None = None, times: DataFrame | None = None, call: int = 0) -> Forecast:
        """Samples of the next rows of each series.  Times to come follow each series' step unless they are given; equal
        calls give equal samples."""
        run = self.run
        return Forecast(forecasts.simulate(run.posterior, run.state, self._future(horizon, times), run.series, run.config, horizon, covariates, call))

    def predict(self, horizon: int, covariates: DataFrame | None = None, times: DataFrame | None = None) -> DataFrame:
        return self.forecast(horizon, covariates, times).mean()

    def forecast_wide(self, horizon: int, levels: Sequence[int] = (80, 90), covariates: DataFrame | None = None, times: DataFrame | None = None, name: str = "model") -> DataFrame:
        return forecasts.wide(self.forecast(horizon, covariates, times).samples, self._future(horizon, times), name, levels)

    def component_draws(self) -> DataFrame:
        return interpret.component_draws(self.run.posterior.where("error IS NULL"), self.run.state)

    def decomposition(self, level: float = 0.9) -> DataFrame:
        return interpret.decomposition(self.component_draws(), self.run.state, level)

    def feature_names(self) -> DataFrame:
        return designs.feature_names(self.run.state, self.config)

    def split_importance(self, block: str = "generic", level: float = 0.9) -> DataFrame:
        return interpret.split_importance(self.run.posterior.where("error IS NULL"), self.feature_names(), block, level)

    def partial_dependence(self, block: str, feature: int, grid: Sequence[float], level: float = 0.9) -> DataFrame:
        run = self.run
        design = designs.design(run.series, run.state, run.config)
        return interpret.partial_dependence(run.posterior.where("error IS NULL"), design, run.state, block, feature, grid, level)

    def girf(self, horizon: int, baseline: DataFrame, shocked: DataFrame, level: float = 0.9, common_noise: bool = False) -> DataFrame:
        """unique_id, h, mean, lower, upper of the response to shocked in place of baseline covariates.

        Each forecast has its own noise, so a response holds twice the noise; common_noise lets it cancel.
        """
        a = self.forecast(horizon, baseline, call=0).samples
        b = self.forecast(horizon, shocked, call=0 if common_noise else 1).samples
        return interpret.bands(interpret.response(a, b), ("unique_id", "h"), level=level)


def plot_decomposition(bands: DataFrame, unique_id: str):
    """Four stacked panels of one series' decomposition; needs matplotlib, which is no dependency."""
    import matplotlib.pyplot as plt

    rows = bands.where(F.col("unique_id") == unique_id).toPandas().sort_values("x")
    figure, axes = plt.subplots(4, sharex=True)
    for ax, name in zip(axes, ("fitted", "trend", "seasonal", "generic")):
        own = rows[rows["component"] == name]
        ax.plot(own["x"], own["mean"])
        ax.fill_between(own["x"], own["lower"], own["upper"], alpha=0.3)
        ax.set_ylabel(name)
    return figure
