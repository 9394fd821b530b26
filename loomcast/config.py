"""Settings of a model as plain dataclasses, with a JSON codec."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

# The names that modes and calendar fields can have.
TREND_MODES = ("tree", "linear", "spline", "tvp")
ERROR_MODES = ("homo", "sv")
CALENDAR_FIELDS = ("month", "dayofweek", "hour", "quarter", "dayofyear", "week")


def _one_of(value: str, names: Sequence[str], what: str) -> None:
    if value not in names:
        raise ValueError(f"{what} must be one of {', '.join(names)}; got {value!r}")


@dataclass(frozen=True)
class SeasonalPeriod:
    """A period in rows, which may be fractional, and its number of harmonics."""

    period: float
    harmonics: int = 3

    def __post_init__(self) -> None:
        if not self.period > 0:
            raise ValueError("period must be positive")
        if self.harmonics < 1:
            raise ValueError("harmonics must be at least 1")


@dataclass(frozen=True)
class TreePrior:
    num_trees: int = 50
    alpha: float = 0.95
    beta: float = 2.0
    leaf_scale: float | None = None
    leaf_scale_factor: float = 3.0
    min_samples_leaf: int = 5
    max_depth: int = -1
    sample_leaf_scale: bool = False

    def leaf_sd(self) -> float:
        """Prior standard deviation of a leaf."""
        return self.leaf_scale if self.leaf_scale is not None else self.leaf_scale_factor / (2.0 * math.sqrt(self.num_trees))


@dataclass(frozen=True)
class TrendConfig:
    mode: str = "spline"
    degree: int = 1
    n_knots: int = 10
    spline_degree: int = 3
    coef_scale: float = 10.0
    smoothing: float = 1.0
    tree_prior: TreePrior = field(default_factory=TreePrior)

    def __post_init__(self) -> None:
        _one_of(self.mode, TREND_MODES, "trend mode")

    @property
    def conjugate(self) -> bool:
        return self.mode in ("linear", "spline")

    def names(self) -> list[str]:
        """Feature names in the order of the design."""
        if self.mode == "tree":
            return ["trend_t", "trend_t^2"]
        if self.mode == "tvp":
            return ["trend_1", "trend_t"]
        if self.mode == "linear":
            return ["trend_1"] + ["trend_t" if d == 1 else f"trend_t^{d}" for d in range(1, self.degree + 1)]
        return ["trend_1", "trend_t"] + [f"trend_spl_{j}" for j in range(1, self.n_knots + self.spline_degree - 1)]

    def penalised(self) -> list[bool]:
        return [n.startswith("trend_spl_") for n in self.names()]


@dataclass(frozen=True)
class SeasonalConfig:
    periods: tuple[SeasonalPeriod, ...] = ()
    calendar: tuple[str, ...] = ()
    sum_to_zero: bool = True
    tree_prior: TreePrior = field(default_factory=TreePrior)

    def __post_init__(self) -> None:
        for c in self.calendar:
            _one_of(c, CALENDAR_FIELDS, "calendar field")


@dataclass(frozen=True)
class GenericConfig:
    lags: tuple[int, ...] = (1,)
    exog: tuple[str, ...] = ()
    future_exog: tuple[str, ...] = ()
    asymmetric: bool = True
    tree_prior: TreePrior = field(default_factory=TreePrior)

    @property
    def covariates(self) -> tuple[str, ...]:
        """Both lists, in order; a name in both counts twice.  Future values are needed for either."""
        return (*self.exog, *self.future_exog)

    @property
    def max_lag(self) -> int:
        return max(self.lags, default=0)

    def names(self) -> list[str]:
        return [f"y_lag{k}" for k in self.lags] + [f"x_{c}" for c in self.covariates]

    def prior(self) -> TreePrior:
        """With asymmetric, fewer and shallower trees with a tighter leaf, so that lags explain what is left over."""
        p = self.tree_prior
        if not self.asymmetric:
            return p
        sd = p.leaf_scale if p.leaf_scale is not None else p.leaf_scale_factor / (4.0 * math.sqrt(p.num_trees))
        return replace(p, num_trees=max(10, p.num_trees // 2), beta=p.beta + 1.0, leaf_scale=sd)


@dataclass(frozen=True)
class ErrorConfig:
    mode: str = "homo"
    nu: float = 3.0
    q: float = 0.90
    sv_phi: float = 0.95
    sv_sigma_h: float = 0.15
    sv_mu_prior_var: float = 10.0

    def __post_init__(self) -> None:
        _one_of(self.mode, ERROR_MODES, "error mode")


@dataclass(frozen=True)
class MCMCConfig:
    num_gfr: int = 10
    num_burnin: int = 200
    num_mcmc: int = 500
    thin: int = 1
    seed: int = 0
    chains: int = 1

    def num_retained_draws(self) -> int:
        return -(-self.num_mcmc // self.thin)


@dataclass(frozen=True)
class ModelConfig:
    trend: TrendConfig = field(default_factory=TrendConfig)
    seasonal: SeasonalConfig = field(default_factory=SeasonalConfig)
    generic: GenericConfig = field(default_factory=GenericConfig)
    error: ErrorConfig = field(default_factory=ErrorConfig)
    mcmc: MCMCConfig = field(default_factory=MCMCConfig)
    multistep: str = "recursive"

    def __post_init__(self) -> None:
        if self.multistep != "recursive":
            raise ValueError("only recursive multistep forecasts exist")

    @property
    def has_seasonal(self) -> bool:
        return bool(self.seasonal.periods or self.seasonal.calendar)

    @property
    def has_generic(self) -> bool:
        return bool(self.generic.names())


def make_config(
    trend: str = "spline",
    periods: Sequence[SeasonalPeriod | Sequence[float] | float] = (),
    calendar: Sequence[str] = (),
    lags: Sequence[int] = (1,),
    exog: Sequence[str] = (),
    future_exog: Sequence[str] = (),
    errors: str = "homo",
    asymmetric: bool = True,
    sum_to_zero: bool = True,
    num_gfr: int = 10,
    num_burnin: int = 200,
    num_mcmc: int = 500,
    thin: int = 1,
    seed: int = 0,
    chains: int = 1,
    smoothing: float = 1.0,
    n_knots: int = 10,
) -> ModelConfig:
    """A configuration from flat arguments.  A period may be a number or a pair (period, harmonics)."""

    def period(p: SeasonalPeriod | Sequence[float] | float) -> SeasonalPeriod:
        if isinstance(p, SeasonalPeriod):
            return p
        return SeasonalPeriod(float(p[0]), int(p[1])) if isinstance(p, (tuple, list)) else SeasonalPeriod(float(p))

    return ModelConfig(
        TrendConfig(mode=trend, smoothing=smoothing, n_knots=n_knots),
        SeasonalConfig(tuple(period(p) for p in periods), tuple(calendar), sum_to_zero),
        GenericConfig(tuple(lags), tuple(exog), tuple(future_exog), asymmetric),
        ErrorConfig(errors),
        MCMCConfig(num_gfr, num_burnin, num_mcmc, thin, seed, chains),
    )


def to_json(config: ModelConfig) -> str:
    return json.dumps(asdict(config), sort_keys=True)


def from_json(text: str) -> ModelConfig:
    d = json.loads(text)

    def prior(x: dict) -> dict:
        return x | {"tree_prior": TreePrior(**x["tree_prior"])}

    s = prior(d["seasonal"])
    s |= {"periods": tuple(SeasonalPeriod(**p) for p in s["periods"]), "calendar": tuple(s["calendar"])}
    g = prior(d["generic"])
    g |= {k: tuple(g[k]) for k in ("lags", "exog", "future_exog")}
    return ModelConfig(TrendConfig(**prior(d["trend"])), SeasonalConfig(**s), GenericConfig(**g), ErrorConfig(**d["error"]), MCMCConfig(**d["mcmc"]), d["multistep"])
