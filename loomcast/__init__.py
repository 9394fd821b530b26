"""loomcast: Bayesian time-series analytics over panels of series, on Spark DataFrames."""

from loomcast.config import (
    ErrorConfig,
    GenericConfig,
    MCMCConfig,
    ModelConfig,
    SeasonalConfig,
    SeasonalPeriod,
    TreePrior,
    TrendConfig,
    make_config,
)
from loomcast.plans.model import Forecast, SeriesModel

__version__ = "0.1.0"
__all__ = [
    "ErrorConfig",
    "Forecast",
    "GenericConfig",
    "MCMCConfig",
    "ModelConfig",
    "SeasonalConfig",
    "SeasonalPeriod",
    "SeriesModel",
    "TreePrior",
    "TrendConfig",
    "make_config",
]
