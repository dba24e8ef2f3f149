"""Small numeric helpers that run inside grouped tasks: penalised least squares, AR(1), beta quantiles."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

L1_RATIOS = {"enet": (0.1, 0.3, 0.5, 0.7, 0.9, 0.95), "lasso": (1.0,)}
N_ALPHAS = {"enet": 50, "lasso": 100}


def alpha_grid(n: int) -> np.ndarray:
    """From 10^4 down to 10^-4."""
    return np.logspace(4, -4, n)


def descend(gram: np.ndarray, xy: np.ndarray, n: int, alpha: float, l1: float, w: np.ndarray, tol: float = 1e-7, most: int = 2000) -> np.ndarray:
    """Coordinate descent for squared error / 2n + alpha (l1 |w| + (1 - l1) / 2 w^2), warm from ``w``; everything through the Gram matrix."""
    w = w.copy()
    a, r = alpha * l1, alpha * (1 - l1)
    for _ in range(most):
        move = 0.0
        for j in range(len(w)):
            d = gram[j, j] / n + r
            if d <= 0:
                continue
            c = (xy[j] - gram[j] @ w + gram[j, j] * w[j]) / n
            new = math.copysign(max(abs(c) - a, 0.0), c) / d
            move = max(move, abs(new - w[j]) * math.sqrt(d))
            w[j] = new
        if move < tol * (1 + np.abs(w).max(initial=0)):
            break
    return w


#: Sweeps between two steps among the terms that are in, and the share of the largest eigenvalue below which a direction is flat.
STEP_EVERY, FLAT = 4, 1e-10


def step_among(g: np.ndarray, c: np.ndarray, a: np.ndarray, r: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From ``v`` to the best values of its terms under their signs, or as far as the first change of sign; and which rows are then optimal."""
    on, s, p = v != 0, np.sign(v), v.shape[1]
    h = np.where(on[:, :, None] & on[:, None, :], g, 0.0)
    h[:, np.arange(p), np.arange(p)] += np.where(on, r[:, None], 1.0)
    unit = np.sqrt(np.maximum(np.einsum("kjj->kj", h), 1e-300))
    values, vectors = np.linalg.eigh(h / (unit[:, :, None] * unit[:, None, :]))
    inverse = np.where(values > FLAT * values[:, -1:], 1 / np.where(values > 0, values, 1.0), 0.0)
    slope = lambda w: c - np.einsum("kij,kj->ki", g, w) - r[:, None] * w
    wish = np.where(on, slope(v) - a[:, None] * s, 0.0) / unit
    move = np.where(on, np.einsum("kij,kj->ki", vectors, inverse * np.einsum("kij,ki->kj", vectors, wish)) / unit, 0.0)
    crossing = np.where(on & (s * (v + move) < 0), -v / np.where(move == 0, 1.0, move), 1.0)
    far = np.minimum(crossing.min(1), 1.0)
    w = np.where((crossing == far[:, None]) & (far[:, None] < 1), 0.0, v + far[:, None] * move)
    left = slope(w)
    room = 1e-9 * (a[:, None] + np.abs(c).max(1, initial=0, keepdims=True) * 1e-3) + 1e-12
    done = np.where(w != 0, np.abs(left - a[:, None] * np.sign(w)) <= room, np.abs(left) <= a[:, None] + room).all(1)
    return w, done


def descend_all(gram: np.ndarray, xy: np.ndarray, n: np.ndarray, alpha: np.ndarray, l1: np.ndarray, tol: float = 1e-7, most: int = 2000) -> np.ndarray:
    """``descend`` for many problems at once, a row each: gram (k, p, p), xy (k, p), and n, alpha and l1 (k).

    Rows that have settled rest. Sweeps find which terms are in and with what signs; every few sweeps a step goes straight to the
    best values under these signs, or to the first term that it would turn, as sweeps alone crawl among controls that move together.
    """
    k, p = xy.shape
    w, open_ = np.zeros((k, p)), np.arange(k)
    g, c, a, r = gram / n[:, None, None], xy / n[:, None], alpha * l1, alpha * (1 - l1)
    d = np.einsum("kjj->kj", g) + r[:, None]
    safe = np.where(d > 0, d, 1.0)
    for sweep in range(1, most + 1):
        if not len(open_):
            break
        v, move = w[open_], np.zeros(len(open_))
        for j in range(p):
            z = c[open_, j] - np.einsum("kp,kp->k", g[open_, j], v) + g[open_, j, j] * v[:, j]
            new = np.where(d[open_, j] > 0, np.sign(z) * np.maximum(np.abs(z) - a[open_], 0.0) / safe[open_, j], 0.0)
            move = np.maximum(move, np.abs(new - v[:, j]) * np.sqrt(np.maximum(d[open_, j], 0)))
            v[:, j] = new
        w[open_] = v
        still = move >= tol * (1 + np.abs(v).max(1, initial=0))
        if sweep % STEP_EVERY == 0 and still.any():
            rest = open_[still]
            w[rest], done = step_among(g[rest], c[rest], a[rest], r[rest], w[rest])
            still[np.flatnonzero(still)[done]] = False
        open_ = open_[still]
    return w


@dataclass(frozen=True)
class Moments:
    """Sums over rows of [1, x, y] and its products: all that a fit and its errors need. Differences of prefixes are segments."""

    gram: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Moments:
        a = np.column_stack([np.ones(len(y)), x, y])
        return cls(a.T @ a)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.gram - other.gram)

    @property
    def n(self) -> int:
        return round(self.gram[0, 0])

    @property
    def mean(self) -> np.ndarray:
        return self.gram[0, 1:] / self.gram[0, 0]

    @property
    def centred(self) -> np.ndarray:
        return self.gram[1:, 1:] - np.outer(self.gram[0, 1:], self.gram[0, 1:]) / self.gram[0, 0]

    def squared_errors(self, intercept: np.ndarray, coef: np.ndarray) -> np.ndarray:
        """Sum of squared errors of predictions intercept + x coef, for many of them."""
        c = np.column_stack([intercept, coef, -np.ones(len(intercept))])
        return np.einsum("ki,ij,kj->k", c, self.gram, c)


def split_positions(n: int, preferred_splits: int) -> list[int]:
    """Where the cross-validation of ``n`` rows needs prefixes: the ends of its expanding training sets, and n."""
    splits = max(2, min(preferred_splits, n // 3)) if n >= 6 else 0
    size = n // (splits + 1)
    return [n - (splits - k) * size for k in range(splits)] + [n]


def fit_moments(method: str, prefixes: list[Moments], unit: float = 1.0) -> Fit:
    """Elastic net or lasso from the moments of the prefixes that ``split_positions`` names; the last is of all rows.

    ``unit`` is what one of y stands for: penalties are those of y in its own units.
    """
    whole = prefixes[-1]
    n, p = whole.n, whole.gram.shape[0] - 2
    scale = np.sqrt(np.maximum(np.diag(whole.centred)[:p] / n, 0.0))
    scale = np.where(scale > 1e-12 * np.maximum(1.0, np.abs(whole.mean[:p])), scale, 1.0)

    def scaled(m: Moments) -> tuple[np.ndarray, np.ndarray]:
        c = m.centred
        return c[:p, :p] / np.outer(scale, scale), c[:p, p] / scale * unit

    if n < 6:
        alpha, l1, cv = 1.0, 1.0 if method == "lasso" else 0.5, False
    else:
        alphas, ratios = alpha_grid(N_ALPHAS[method]), np.array(L1_RATIOS[method])
        a, r = np.tile(alphas, len(ratios)), np.repeat(ratios, len(alphas))
        train, test = prefixes[:-1], [prefixes[k + 1] - prefixes[k] for k in range(len(prefixes) - 1)]
        grams, xys, ns = zip(*((*scaled(m), m.n) for m in train), strict=True)
        k = len(a)
        w = descend_all(np.repeat(grams, k, 0), np.repeat(xys, k, 0), np.repeat(ns, k).astype(float), np.tile(a, len(train)), np.tile(r, len(train)))
        errors = np.zeros(k)
        for m, t, own in zip(train, test, w.reshape(len(train), k, p), strict=True):
            coef = own / scale / unit
            errors += t.squared_errors(m.mean[p] - coef @ m.mean[:p], coef) / t.n / len(train)
        best = int(np.argmin(errors))
        alpha, l1, cv = a[best], r[best], True
    gram, xy = scaled(whole)
    w = descend_all(gram[None], xy[None], np.array([float(n)]), np.array([alpha]), np.array([l1]), most=10000)[0]
    return Fit(whole.mean[:p], scale, float(whole.mean[p]), w / unit, float(alpha), float(l1), cv)


def time_splits(n: int, splits: int):
    """Expanding training sets, each followed by n // (splits + 1) tests."""
    size = n // (splits + 1)
    for k in range(splits):
        at = n - (splits - k) * size
        yield np.arange(at), np.arange(at, at + size)


@dataclass(frozen=True)
class Fit:
    mean: np.ndarray
    scale: np.ndarray
    intercept: float
    coef: np.ndarray
    alpha: float
    l1_ratio: float
    used_cv: bool

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + ((x - self.mean) / self.scale) @ self.coef


def fit_regularised(method: str, x: np.ndarray, y: np.ndarray, preferred_splits: int) -> Fit:
    """Elastic net or lasso on standardised columns; its penalty from expanding splits in time, or fixed at 1 below six rows."""
    middle, spread = np.r_[x.mean(0), y.mean()], np.r_[x.std(0), y.std()]  # moments of like size, whatever the units
    spread = np.where(spread > 0, spread, 1.0)
    z, v = (x - middle[:-1]) / spread[:-1], (y - middle[-1]) / spread[-1]
    fit = fit_moments(method, [Moments.of(z[:k], v[:k]) for k in split_positions(len(y), preferred_splits)], unit=spread[-1])
    return Fit(middle[:-1] + fit.mean * spread[:-1], fit.scale * spread[:-1], float(middle[-1] + fit.intercept * spread[-1]), fit.coef * spread[-1], fit.alpha, fit.l1_ratio, fit.used_cv)


def window_errors(y: np.ndarray, p: np.ndarray) -> dict:
    d = (np.abs(y) + np.abs(p)) / 2
    bias, lift = float((p - y).mean()), float(y.sum() - p.sum())
    return {"smape": float((np.abs(y - p) / np.where(d == 0, 1e-8, d)).mean() * 100), "rmse": float(np.sqrt(((y - p) ** 2).mean())), "bias": bias, "bias_pct": bias / y.mean() * 100 if y.mean() else None, "uplift": lift, "uplift_pct": lift / p.sum() * 100 if p.sum() else None}


def ar1(r: np.ndarray) -> tuple[float, float]:
    """Persistence and innovation deviation of residuals."""
    if len(r) < 3:
        return 0.0, float(np.std(r)) if len(r) else 0.0
    rho = float(np.clip(np.corrcoef(r[:-1], r[1:])[0, 1], -0.99, 0.99)) if r[:-1].std() > 0 and r[1:].std() > 0 else 0.0
    e = r[1:] - rho * r[:-1]
    return rho, float(e.std(ddof=1)) if len(e) > 1 else float(e.std())


def ar1_paths(rho: float, sigma: float, periods: int, n: int, rng: np.random.Generator, start: float = 0.0) -> np.ndarray:
    out, last = np.empty((n, periods)), np.full(n, start)
    for t in range(periods):
        last = out[:, t] = rho * last + rng.normal(0.0, sigma, n)
    return out


def block_bootstrap_sums(r: np.ndarray, n: int, periods: int, rng: np.random.Generator) -> np.ndarray:
    """Sums over a horizon of circular blocks of residuals."""
    length = min(8, max(2, 2 * round(len(r) ** (1 / 3))), len(r))
    starts = rng.integers(0, len(r), (n, -(-periods // length)))
    idx = (starts[:, :, None] + np.arange(length)) % len(r)
    return r[idx].reshape(n, -1)[:, :periods].sum(1)


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def beta_ppf(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    return (0.0 if k == 0 else beta_ppf(alpha / 2, k, n - k + 1)), (1.0 if k == n else beta_ppf(1 - alpha / 2, k + 1, n - k))
