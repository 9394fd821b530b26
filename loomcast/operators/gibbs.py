"""The sampler of one chain of one series: backfitting of trend, seasonal and generic blocks over a shared residual.

Chains are sequential, so this runs inside a grouped map whose groups are (series, chain); operators/fit.py builds it.
Everything here works on the standardised target of one series in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np

from loomcast.config import ModelConfig, TreePrior

# The ten-component normal mixture for log chi-squared(1) of Omori, Chib, Shephard and Nakajima (2007):
# weights, means, variances.
MIX_P = np.array([0.00609, 0.04775, 0.13057, 0.20674, 0.22715, 0.18842, 0.12047, 0.05591, 0.01575, 0.00115])
MIX_M = np.array([1.92677, 1.34744, 0.73504, 0.02266, -0.85173, -1.97278, -3.46788, -5.55246, -8.68384, -14.65000])
MIX_V = np.array([0.11265, 0.17788, 0.26768, 0.40611, 0.62699, 0.98583, 1.57469, 2.54498, 4.16591, 7.33342])


def chi2_quantile(p: float, nu: float) -> float:
    """By bisection on the series of the regularised lower incomplete gamma function."""

    def cdf(x: float) -> float:
        a, h = nu / 2.0, x / 2.0
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1.0
            term *= h / k
            total += term
        return total * math.exp(-h + a * math.log(h) - math.lgamma(a)) if h > 0 else 0.0

    lo, hi = 0.0, max(1.0, nu)
    while cdf(hi) < p:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2.0


def variance_prior(z: np.ndarray, x: np.ndarray, nu: float, q: float) -> tuple[float, float]:
    """Shape and rate of the inverse gamma prior: its q-quantile is the residual variance of least squares."""
    try:
        rest = z - x @ np.linalg.lstsq(x, z, rcond=None)[0] if x.size else z
        var = max(float(np.var(rest)), 1e-3)
    except np.linalg.LinAlgError:
        var = 1.0
    return nu / 2.0, nu * (var * chi2_quantile(1.0 - q, nu) / nu) / 2.0


def trend_precision(penalised: np.ndarray, coef_scale: float, smoothing: float) -> np.ndarray:
    """Prior precision of trend coefficients: a ridge, and second differences of three or more penalised ones."""
    prior = np.eye(len(penalised)) / coef_scale**2
    at = np.flatnonzero(penalised)
    if len(at) >= 3 and smoothing > 0:
        d = np.diff(np.eye(len(at)), n=2, axis=0)
        prior[np.ix_(at, at)] += smoothing * d.T @ d
    return prior


def draw_normal(rng: np.random.Generator, precision: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From N(precision^-1 b, precision^-1)."""
    low = np.linalg.cholesky(precision)
    return np.linalg.solve(low.T, np.linalg.solve(low, b) + rng.standard_normal(len(b)))


class LinearTrend:
    """Conjugate draw of the coefficients given all else."""

    def __init__(self, x: np.ndarray, penalised: np.ndarray, coef_scale: float, smoothing: float) -> None:
        self.x, self.prior = x, trend_precision(penalised, coef_scale, smoothing)
        self.gram, self.fit, self.beta = x.T @ x, np.zeros(len(x)), np.zeros(x.shape[1])

    def sweep(self, r: np.ndarray, var: np.ndarray, rng: np.random.Generator, _: bool) -> None:
        r += self.fit
        even = var[0] == var[-1] and bool((var == var[0]).all())
        gram = self.gram / var[0] if even else self.x.T @ (self.x / var[:, None])
        self.beta = draw_normal(rng, gram + self.prior, self.x.T @ (r / var))
        self.fit = self.x @ self.beta
        r -= self.fit


class DriftTrend:
    """Coefficients of (1, t) that walk at random: forward filter, backward sampling."""

    def __init__(self, x: np.ndarray, coef_scale: float, smoothing: float) -> None:
        self.x, self.fit, self.beta = x, np.zeros(len(x)), np.zeros(x.shape[1])
        self.step = walk_variance(len(x), coef_scale, smoothing)

    def sweep(self, r: np.ndarray, var: np.ndarray, rng: np.random.Generator, _: bool) -> None:
        r += self.fit
        n, d = self.x.shape
        drift = self.step * np.eye(d)
        m, c = np.zeros(d), 100.0 * np.eye(d)
        ms, cs = np.empty((n, d)), np.empty((n, d, d))
        for k in range(n):
            f, p = self.x[k], c + drift
            gain = p @ f / (f @ p @ f + var[k])
            m = m + gain * (r[k] - f @ m)
            c = p - np.outer(gain, f @ p)
            c = (c + c.T) / 2.0 + 1e-10 * np.eye(d)
            ms[k], cs[k] = m, c
        path = np.empty((n, d))
        noise = rng.standard_normal((n, d))
        path[-1] = m + np.linalg.cholesky(c) @ noise[-1]
        for k in range(n - 2, -1, -1):
            back = np.linalg.solve(cs[k] + drift, cs[k]).T
            cov = cs[k] - back @ cs[k]
            cov = (cov + cov.T) / 2.0 + 1e-10 * np.eye(d)
            path[k] = ms[k] + back @ (path[k + 1] - ms[k]) + np.linalg.cholesky(cov) @ noise[k]
        self.beta = path[-1]
        self.fit = (self.x * path).sum(1)
        r -= self.fit


def walk_variance(n: int, coef_scale: float, smoothing: float) -> float:
    return max(coef_scale**2 / n * smoothing, 1e-6)


@dataclass
class Node:
    depth: int
    up: Node | None
    rows: np.ndarray
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


class Tree:
    """One tree, its leaves with the rows in them, and what it adds to the fit."""

    def __init__(self, n: int) -> None:
        self.root = Node(0, None, np.arange(n))
        self.leaves, self.fit = [self.root], np.zeros(n)

    def twigs(self) -> list[Node]:
        """Inner nodes of which both children are leaves."""
        ups = [k.up for k in self.leaves if k.up is not None]
        return list({id(u): u for u in ups if u.left.feature < 0 and u.right.feature < 0}.values())

    def flat(self) -> list[tuple[int, float, int, int, float]]:
        """(feat, thresh, left, right, value) of every node, the root first."""
        out: list = []

        def put(node: Node) -> int:
            at = len(out)
            out.append(None)
            if node.feature < 0:
                out[at] = (-1, 0.0, -1, -1, node.value)
            else:
                left = put(node.left)
                out[at] = (node.feature, node.cut, left, put(node.right), 0.0)
            return at

        put(self.root)
        return out


class Forest:
    """Sum of trees: each proposes to grow or prune, then draws its leaves, against the residual without it.

    Features are held as the numbers of their sorted distinct values, so that a node's cuts are counted, not sorted.
    """

    def __init__(self, x: np.ndarray, prior: TreePrior) -> None:
        self.prior = prior
        self.levels, self.codes = zip(*(np.unique(c, return_inverse=True) for c in x.T))
        self.trees = [Tree(len(x)) for _ in range(prior.num_trees)]
        self.scale = prior.leaf_sd() ** 2
        self.fit = np.zeros(len(x))

    def _evidence(self, p: float, q: float) -> float:
        """Of a leaf with these sums of weights and of weighted residuals."""
        a = 1.0 / self.scale
        return 0.5 * math.log(a / (a + p)) + 0.5 * q * q / (a + p)

    def _gain(self, w: np.ndarray, wr: np.ndarray, left: np.ndarray, right: np.ndarray) -> float:
        """What the evidence gains by two leaves with these rows in place of one."""
        pl, ql, pr, qr = w[left].sum(), wr[left].sum(), w[right].sum(), wr[right].sum()
        return self._evidence(pl, ql) + self._evidence(pr, qr) - self._evidence(pl + pr, ql + qr)

    def _cuts(self, rows: np.ndarray, feature: int) -> tuple[np.ndarray, np.ndarray]:
        """The codes of these rows, and those after which a cut leaves enough rows on both sides."""
        own, least = self.codes[feature][rows], max(1, self.prior.min_samples_leaf)
        if 4 * len(own) < len(self.levels[feature]):
            found, counts = np.unique(own, return_counts=True)
        else:
            counts = np.bincount(own, minlength=len(self.levels[feature]))
            found = np.flatnonzero(counts)
            counts = counts[found]
        below = np.cumsum(counts)
        return own, found[(below >= least) & (len(own) - below >= least)]

    def _split_prob(self, depth: int) -> float:
        return self.prior.alpha * (1.0 + depth) ** -self.prior.beta

    def _ratio(self, node: Node, gain: float, from_root: bool, leaves: int, twigs: int) -> float:
        """Log acceptance of growing node, given the leaves before and the twigs after."""
        here, below = self._split_prob(node.depth), self._split_prob(node.depth + 1)
        return gain + math.log(here) + 2.0 * math.log1p(-below) - math.log1p(-here) + math.log(0.5 / (1.0 if from_root else 0.5)) + math.log(leaves) - math.log(twigs)

    def _grow(self, tree: Tree, w: np.ndarray, wr: np.ndarray, rng: np.random.Generator) -> None:
        node = tree.leaves[rng.integers(len(tree.leaves))]
        if 0 <= self.prior.max_depth < node.depth + 1 or len(node.rows) < 2 * self.prior.min_samples_leaf:
            return
        for f in rng.permutation(len(self.codes)):
            own, cuts = self._cuts(node.rows, f)
            if len(cuts):
                break
        else:
            return
        cut = cuts[rng.integers(len(cuts))]
        goes = own <= cut
        left, right = node.rows[goes], node.rows[~goes]
        gain = self._gain(w, wr, left, right)
        sibling = None if node.up is None else node.up.right if node.up.left is node else node.up.left
        twigs = len(tree.twigs()) + 1 - (sibling is not None and sibling.feature < 0)
        if math.log(rng.random()) < self._ratio(node, gain, len(tree.leaves) == 1, len(tree.leaves), twigs):
            node.feature, node.cut = int(f), float(self.levels[f][cut])
            node.left, node.right = (Node(node.depth + 1, node, rows) for rows in (left, right))
            tree.leaves = [k for k in tree.leaves if k is not node] + [node.left, node.right]

    def _prune(self, tree: Tree, w: np.ndarray, wr: np.ndarray, rng: np.random.Generator) -> None:
        twigs = tree.twigs()
        if not twigs:
            return
        node = twigs[rng.integers(len(twigs))]
        gain = self._gain(w, wr, node.left.rows, node.right.rows)
        if math.log(rng.random()) < -self._ratio(node, gain, node is tree.root, len(tree.leaves) - 1, len(twigs)):
            gone = {id(node.left), id(node.right)}
            tree.leaves = [k for k in tree.leaves if id(k) not in gone] + [node]
            node.feature, node.left, node.right = -1, None, None

    def sweep(self, r: np.ndarray, var: np.ndarray, rng: np.random.Generator, warm: bool) -> None:
        """warm: three growing moves for each tree instead of one move of either kind."""
        w = 1.0 / var
        for tree in self.trees:
            r += tree.fit
            wr = w * r
            if warm:
                for _ in range(3):
                    self._grow(tree, w, wr, rng)
            elif len(tree.leaves) == 1 or rng.random() < 0.5:
                self._grow(tree, w, wr, rng)
            else:
                self._prune(tree, w, wr, rng)
            noise = rng.standard_normal(len(tree.leaves))
            for node, e in zip(tree.leaves, noise):
                p = 1.0 / self.scale + w[node.rows].sum()
                node.value = wr[node.rows].sum() / p + e / math.sqrt(p)
                tree.fit[node.rows] = node.value
            r -= tree.fit
        self.fit = np.sum([t.fit for t in self.trees], axis=0)

    def draw_scale(self, rng: np.random.Generator) -> None:
        values = np.array([k.value for t in self.trees for k in t.leaves])
        self.scale = (1.0 + 0.5 * float(values @ values)) / rng.standard_gamma(1.0 + len(values) / 2.0)

    def flat(self) -> list[list[tuple]]:
        return [t.flat() for t in self.trees]


class Volatility:
    """Log variance as a stationary AR(1) around mu, by the mixture approximation."""

    def __init__(self, phi: float, sd: float, mu_var: float) -> None:
        self.phi, self.sd, self.mu_var = phi, sd, mu_var
        self.h: np.ndarray | None = None
        self.mu = 0.0

    def draw(self, e: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        n = len(e)
        if self.h is None:
            self.mu = math.log(float(np.var(e)) + 1e-8)
            self.h = np.full(n, self.mu)
        u = np.log(e * e + 1e-10)
        gap = u[:, None] - self.h[:, None] - MIX_M
        logp = np.log(MIX_P) - 0.5 * np.log(MIX_V) - 0.5 * gap * gap / MIX_V
        cdf = np.cumsum(np.exp(logp - logp.max(1, keepdims=True)), axis=1)
        k = (rng.random(n)[:, None] * cdf[:, -1:] > cdf).sum(1)
        seen, v = (u - MIX_M[k] - self.mu).tolist(), MIX_V[k].tolist()
        phi, q = self.phi, self.sd**2
        m, c = 0.0, q / (1.0 - phi * phi)
        ms, cs = [], []
        for j in range(n):
            a, p = (m, c) if j == 0 else (phi * m, phi * phi * c + q)
            g = p / (p + v[j])
            m, c = a + g * (seen[j] - a), p * (1.0 - g)
            ms.append(m)
            cs.append(c)
        noise = rng.standard_normal(n).tolist()
        path = [0.0] * n
        path[-1] = m + math.sqrt(c) * noise[-1]
        for j in range(n - 2, -1, -1):
            g = phi * cs[j] / (phi * phi * cs[j] + q)
            path[j] = ms[j] + g * (path[j + 1] - phi * ms[j]) + math.sqrt(cs[j] * (1.0 - g * phi)) * noise[j]
        self.h = self.mu + np.array(path)
        steps = self.h[1:] - phi * self.h[:-1]
        precision = 1.0 / self.mu_var + (1.0 - phi * phi) / q + (n - 1) * (1.0 - phi) ** 2 / q
        mean = ((1.0 - phi * phi) * self.h[0] + (1.0 - phi) * steps.sum()) / q / precision
        self.mu = mean + rng.standard_normal() / math.sqrt(precision)
        return np.exp(self.h)


def seed_for(seed: int, unique_id: str, chain: int, call: int = 0) -> np.random.Generator:
    """A generator that depends on the series and the chain only, not on how rows are partitioned."""
    import zlib

    return np.random.default_rng(np.random.SeedSequence([seed, zlib.crc32(unique_id.encode()), chain, call]))


class Block(Protocol):
    """What a part of the model must offer, so that a builder can put one of its own in the place of any here.

    fit is what it adds to the series in sample.  sweep takes the residual without any block's fit changed so far, adds
    its fit back, draws anew given the noise variances and takes the new fit off again, all in place; warm marks the
    first sweeps, which may move faster.
    """

    fit: np.ndarray

    def sweep(self, r: np.ndarray, var: np.ndarray, rng: np.random.Generator, warm: bool) -> None: ...


#: A builder: the blocks by the names trend, seasonal and generic, of a configuration and the three designs.
Builder = Callable[[ModelConfig, np.ndarray, np.ndarray, np.ndarray], dict[str, Block]]


def blocks_of(cfg: ModelConfig, x_tr: np.ndarray, x_se: np.ndarray, x_ge: np.ndarray) -> dict[str, Block]:
    """The blocks of a configuration; a design without columns makes none."""
    t = cfg.trend
    if t.mode == "tree":
        blocks: dict[str, Block] = {"trend": Forest(x_tr, t.tree_prior)}
    elif t.mode == "tvp":
        blocks = {"trend": DriftTrend(x_tr, t.coef_scale, t.smoothing)}
    else:
        blocks = {"trend": LinearTrend(x_tr, np.array(t.penalised()), t.coef_scale, t.smoothing)}
    if x_se.shape[1]:
        blocks["seasonal"] = Forest(x_se, cfg.seasonal.tree_prior)
    if x_ge.shape[1]:
        blocks["generic"] = Forest(x_ge, cfg.generic.prior())
    return blocks


def run_chain(z: np.ndarray, x_tr: np.ndarray, x_se: np.ndarray, x_ge: np.ndarray, cfg: ModelConfig, rng: np.random.Generator, build: Builder = blocks_of):
    """Yield a dict for each kept draw: parameters, component paths and flattened trees."""
    blocks = build(cfg, x_tr, x_se, x_ge)
    trend = blocks["trend"]
    n, r = len(z), z.copy()
    shape, rate = variance_prior(z, np.hstack([x_tr, x_se, x_ge]), cfg.error.nu, cfg.error.q)
    sv = Volatility(cfg.error.sv_phi, cfg.error.sv_sigma_h, cfg.error.sv_mu_prior_var) if cfg.error.mode == "sv" else None
    var = np.ones(n)
    m = cfg.mcmc
    for sweep in range(m.num_gfr + m.num_burnin + m.num_mcmc):
        for b in blocks.values():
            b.sweep(r, var, rng, sweep < m.num_gfr)
        if sv is not None:
            var = sv.draw(r, rng)
        else:
            var = np.full(n, (rate + 0.5 * float(r @ r)) / rng.standard_gamma(shape + n / 2.0))
        kept = sweep - m.num_gfr - m.num_burnin
        if kept < 0 or kept % m.thin:
            continue
        for b in blocks.values():
            if isinstance(b, Forest) and b.prior.sample_leaf_scale:
                b.draw_scale(rng)
        paths = {k: blocks[k].fit.copy() if k in blocks else np.zeros(n) for k in ("trend", "seasonal", "generic")}
        yield {
            "draw": kept // m.thin,
            "beta": np.array(getattr(trend, "beta", ()), float),
            "sigma2": float(var[0]) if sv is None else None,
            "h_last": None if sv is None else float(sv.h[-1]),
            "sv_mu": None if sv is None else float(sv.mu),
            "sigma2_t": np.empty(0) if sv is None else var,
            **paths,
            **{f"{k}_trees": blocks[k].flat() if isinstance(blocks.get(k), Forest) else [] for k in ("trend", "seasonal", "generic")},
            "gap": float(np.abs(z - sum(paths.values()) - r).max()),
        }


def run_moments_chain(n: int, gram: np.ndarray, cross: np.ndarray, zz: float, penalised: np.ndarray, cfg: ModelConfig, rng: np.random.Generator):
    """The chain of a model with a conjugate trend alone, from the sums X'X, X'z and z'z; same law as run_chain."""
    prior = trend_precision(penalised, cfg.trend.coef_scale, cfg.trend.smoothing)

    def squares(beta: np.ndarray) -> float:
        return max(zz - 2.0 * float(beta @ cross) + float(beta @ gram @ beta), 0.0)

    ols = np.linalg.lstsq(gram, cross, rcond=None)[0]
    nu = cfg.error.nu
    rate = max(squares(ols) / n, 1e-3) * chi2_quantile(1.0 - cfg.error.q, nu) / 2.0
    var, m = 1.0, cfg.mcmc
    for sweep in range(m.num_gfr + m.num_burnin + m.num_mcmc):
        beta = draw_normal(rng, gram / var + prior, cross / var)
        var = (rate + 0.5 * squares(beta)) / rng.standard_gamma(nu / 2.0 + n / 2.0)
        kept = sweep - m.num_gfr - m.num_burnin
        if kept >= 0 and kept % m.thin == 0:
            yield {"draw": kept // m.thin, "beta": beta, "sigma2": var}
