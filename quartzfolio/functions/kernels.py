"""Matrix kernels of one estimation window, on numpy alone.

Spark calls them inside grouped maps: one call per window, a few dozen rows and
columns each. They refuse inputs without an answer instead of returning NaN.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from ..errors import Refusal

# Components


def correlation(x: np.ndarray) -> np.ndarray:
    if x.shape[1] < 2 or not np.isfinite(x).all() or (x.std(0) == 0).any():
        raise Refusal("no correlation: a gap, a constant or a single series")
    return np.corrcoef(x, rowvar=False)


def eigen(corr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(corr)
    values, vectors = values[::-1], vectors[:, ::-1]
    top = np.abs(vectors).argmax(0)
    return values, vectors * np.where(vectors[top, range(len(values))] < 0, -1.0, 1.0)


def varimax(loadings: np.ndarray, rounds: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    scale = np.sqrt((loadings**2).sum(1, keepdims=True))
    a, r, last = loadings / np.where(scale > 0, scale, 1), np.eye(loadings.shape[1]), 0.0
    for _ in range(rounds):
        b = a @ r
        u, s, v = np.linalg.svd(a.T @ (b**3 - b * (b**2).mean(0)))
        r = u @ v
        if s.sum() - last < tolerance:
            break
        last = s.sum()
    return a @ r * scale


# Means


def jorion(x: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Bayes-Stein: towards the minimum-variance portfolio's mean."""
    t, n = x.shape
    mean, one = x.mean(0), np.ones(n)
    inverse = np.linalg.inv(cov)
    base = float(one @ inverse @ mean / (one @ inverse @ one))
    q = float((mean - base) @ inverse @ (mean - base))
    share = (n + 2) / ((n + 2) + t * q)
    return (1 - share) * mean + share * base


def posterior(prior: np.ndarray, cov: np.ndarray, tau: float, views: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Black-Litterman posterior mean for one view on each asset, precision form."""
    a, b = np.linalg.inv(tau * cov), np.linalg.inv(omega)
    if np.linalg.cond(a + b) > 1e12:
        raise Refusal("the posterior precision can't be inverted")
    return np.linalg.solve(a + b, a @ prior + b @ views)


def black_litterman(x: np.ndarray, cov: np.ndarray, policy: np.ndarray, gamma: float, setting: float = 1.0) -> np.ndarray:
    t = len(x)
    return posterior(gamma * cov @ policy, cov, setting / t, x.mean(0), np.diag(np.diag(cov)) / t)


# Constructors


def bounded_simplex(target: np.ndarray, cap: float) -> np.ndarray:
    """Clipped to [0, cap] and brought to sum one: what is missing is shared by room,
    what is over is removed by holding."""
    n = len(target)
    if cap * n < 1 - 1e-12:
        raise Refusal("the cap leaves no full investment")
    w = np.clip(np.asarray(target, float), 0, cap)
    for _ in range(n + 1):
        gap = 1 - w.sum()
        if abs(gap) <= 1e-12:
            break
        share = cap - w if gap > 0 else w
        w = np.clip(w + gap * share / share.sum(), 0, cap)
    if abs(w.sum() - 1) > 1e-9 or w.min() < -1e-9 or w.max() > cap + 1e-9:
        raise Refusal("the projection left the constraint set")
    return w


def quadratic(q: np.ndarray, c: np.ndarray, cap: float) -> np.ndarray:
    """argmin w'qw/2 - c'w over the capped simplex: primal active set, from 1/n."""
    n = len(c)
    if cap * n < 1 - 1e-12:
        raise Refusal("the cap leaves no full investment")
    q = q + np.eye(n) * (1e-12 * np.trace(q) / n + 1e-300)
    scale = max(np.abs(q).max(), np.abs(c).max(), 1e-300)
    q, c = q / scale, c / scale
    w, low, high = np.full(n, 1 / n), np.zeros(n, bool), np.zeros(n, bool)
    for _ in range(50 * n + 200):
        free = np.flatnonzero(~(low | high))
        step = np.zeros(n)
        if len(free):
            k = len(free)
            kkt = np.block([[q[np.ix_(free, free)], np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
            step[free] = np.linalg.lstsq(kkt, np.r_[(c - q @ w)[free], 0.0], rcond=None)[0][:k]
        if np.abs(step).max() < 1e-13:
            gradient = q @ w - c
            level = gradient[free].mean() if len(free) else np.median(gradient[low | high])
            wrong = np.where(low, level - gradient, np.where(high, gradient - level, 0))
            worst = int(wrong.argmax())
            if wrong[worst] <= 1e-11:
                return np.clip(w, 0, cap) / np.clip(w, 0, cap).sum()
            low[worst] = high[worst] = False
            if not len(free):  # a second one must move as well
                other = np.where(low, gradient - level, np.where(high, level - gradient, np.inf))
                second = int(np.abs(other).argmin())
                low[second] = high[second] = False
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(step > 0, (cap - w) / step, np.where(step < 0, -w / step, np.inf))
        room[~np.isfinite(room)] = np.inf
        size = min(1.0, room.min())
        w = w + size * step
        if size < 1:
            hit = int(room.argmin())
            low[hit], high[hit] = step[hit] < 0, step[hit] > 0
            w[hit] = 0.0 if step[hit] < 0 else cap
    return np.clip(w, 0, cap) / np.clip(w, 0, cap).sum()


def minimum_variance(cov, mean, x, cap, policy, **_):
    return quadratic(cov, np.zeros(len(cov)), cap)


def mean_variance(cov, mean, x, cap, policy, gamma: float = 1 / 3, norm: float | None = None, **_):
    n = len(cov)
    if norm is not None:
        if norm < n**-0.5 - 1e-12:
            raise Refusal("no full investment has so small a norm")
        if norm <= n**-0.5 + 1e-12:
            return np.full(n, 1 / n)  # the only feasible point
    w = quadratic(gamma * cov, mean, cap)
    if norm is not None and np.linalg.norm(w) > norm:
        low, high = 0.0, 1.0
        while np.linalg.norm(quadratic(gamma * cov + high * np.eye(n), mean, cap)) > norm:
            high *= 4
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if np.linalg.norm(quadratic(gamma * cov + mid * np.eye(n), mean, cap)) > norm else (low, mid)
        w = quadratic(gamma * cov + high * np.eye(n), mean, cap)
    return w


def diversification_ratio(w: np.ndarray, cov: np.ndarray) -> float:
    return float(w @ np.sqrt(np.diag(cov)) / math.sqrt(w @ cov @ w))


def maximum_diversification(cov, mean, x, cap, policy, **_):
    """The optimum solves min w'cov w / 2 - t w'sd at t = w'cov w / w'sd. The ratio is flat
    there, so half of its digits are all it tells: it chooses only where no step settles."""
    sd = np.sqrt(np.diag(cov))
    best = w = bounded_simplex((1 / sd) / (1 / sd).sum(), cap)
    for _ in range(300):
        new = quadratic(cov, float(w @ cov @ w) / float(w @ sd) * sd, cap)
        if diversification_ratio(new, cov) > diversification_ratio(best, cov):
            best = new
        if np.abs(new - w).max() < 1e-12:
            return new
        w = new
    return best


def _risk_gap(w: np.ndarray, cov: np.ndarray) -> tuple[float, np.ndarray]:
    m, n = cov @ w, len(w)
    v = float(w @ m)
    s = math.sqrt(v)
    e = w * m / s - s / n
    jac = (np.diag(m) + w[:, None] * cov) / s - np.outer(w * m, m) / s**3 - m[None, :] / (s * n)
    return float(e @ e), 2 * jac.T @ e


def erc(cov, mean, x, cap, policy, **_):
    """Equal risk contributions; under a binding cap, the least squared gap."""
    n = len(cov)
    y = 1 / np.sqrt(np.diag(cov))
    for _ in range(2000):
        old = y.copy()
        for i in range(n):
            a = cov[i] @ y - cov[i, i] * y[i]
            y[i] = (-a + math.sqrt(a * a + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(y - old).max() < 1e-14 * np.abs(y).max():
            break
    w = y / y.sum()
    if w.max() <= cap + 1e-12:
        return w
    w = bounded_simplex(w, cap)
    value, gradient = _risk_gap(w, cov)
    size = 1.0 / max(np.abs(gradient).max(), 1e-300)
    for _ in range(3000):
        new = _project(w - size * gradient, cap)
        got, slope = _risk_gap(new, cov)
        if got < value:
            moved, w, value, gradient, size = np.abs(new - w).max(), new, got, slope, size * 1.5
            if moved < 1e-13:
                break
        else:
            size /= 2
            if size * np.abs(gradient).max() < 1e-15:
                break
    return w


def _project(v: np.ndarray, cap: float) -> np.ndarray:
    """Nearest point of the capped simplex."""
    low, high = v.min() - cap - 1, v.max() + 1
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(v - mid, 0, cap).sum() > 1 else (low, mid)
    w = np.clip(v - (low + high) / 2, 0, cap)
    return w / w.sum()


def linkage_order(distance: np.ndarray) -> list[int]:
    """Leaves of the single-linkage tree, the cluster with the lower number first."""
    n = len(distance)
    clusters, link = {i: [i] for i in range(n)}, {(i, j): distance[i, j] for i in range(n) for j in range(i + 1, n)}
    new = n
    while len(clusters) > 1:
        a, b = min(link, key=lambda k: (link[k], k))
        merged = clusters.pop(a) + clusters.pop(b)
        for c in clusters:
            link[(c, new)] = min(link[tuple(sorted((a, c)))], link[tuple(sorted((b, c)))])
        link = {k: v for k, v in link.items() if a not in k and b not in k}
        clusters[new], new = merged, new + 1
    return next(iter(clusters.values()))


def hierarchical_risk_parity(cov, mean, x, cap, policy, **_):
    sd = np.sqrt(np.diag(cov))
    corr = np.clip(cov / np.outer(sd, sd), -1, 1)
    order = linkage_order(np.sqrt(np.maximum(0.5 * (1 - corr), 0)))

    def variance(items: list[int]) -> float:
        part = cov[np.ix_(items, items)]
        w = 1 / np.diag(part)
        w /= w.sum()
        return float(w @ part @ w)

    weights, todo = np.ones(len(cov)), [order]
    while todo:
        items = todo.pop()
        if len(items) > 1:
            left, right = items[: len(items) // 2], items[len(items) // 2 :]
            a, b = variance(left), variance(right)
            share = b / (a + b) if a + b > 0 else 0.5  # two halves without variance share alike
            weights[left] *= share
            weights[right] *= 1 - share
            todo += [left, right]
    return bounded_simplex(weights, cap)


def linear_programme(c: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """min c'x with ax = b, x >= 0: Mehrotra's predictor-corrector interior point."""
    m, n = a.shape
    x = np.maximum(a.T @ np.linalg.solve(a @ a.T + 1e-12 * np.eye(m), b), 1.0)
    y, s = np.zeros(m), np.maximum(c, 1.0)
    for _ in range(rounds):
        rp, rd, mu = b - a @ x, c - a.T @ y - s, float(x @ s) / n
        if max(np.abs(rp).max(), np.abs(rd).max(), mu) < 1e-11:
            break
        d = x / s
        normal = a * d @ a.T + 1e-14 * np.eye(m)

        def direction(rc: np.ndarray, rp=rp, rd=rd, d=d, normal=normal, x=x, s=s):
            dy = np.linalg.solve(normal, rp + a @ (d * rd - rc / s))
            ds = rd - a.T @ dy
            return (rc - x * ds) / s, dy, ds

        dx, dy, ds = direction(-x * s)
        reach = lambda v, dv: min(1.0, float(np.min(np.where(dv < 0, -v / np.where(dv < 0, dv, -1), np.inf))))
        aim = (float((x + reach(x, dx) * dx) @ (s + reach(s, ds) * ds)) / n / mu) ** 3 * mu
        dx, dy, ds = direction(aim - x * s - dx * ds)
        p, q = 0.995 * reach(x, dx), 0.995 * reach(s, ds)
        x, y, s = x + p * dx, y + q * dy, s + q * ds
    return x


def expected_shortfall(returns: np.ndarray, level: float = 0.05) -> float:
    worst = np.sort(-returns)[::-1][: math.ceil(level * len(returns))]
    return float(worst.mean())


def mean_cvar(cov, mean, x, cap, policy, level: float = 0.05, **_):
    """Least conditional value at risk (Rockafellar and Uryasev, 2000). The quantile
    variable is shifted by the largest move, so that every variable is at least 0."""
    t, n = x.shape
    shift = float(np.abs(x).max()) or 1.0
    x = x / shift
    a = np.block([
        [np.ones((1, n)), np.zeros((1, n + 1 + 2 * t))],
        [np.eye(n), np.eye(n), np.zeros((n, 1 + 2 * t))],
        [x, np.zeros((t, n)), np.ones((t, 1)), np.eye(t), -np.eye(t)],
    ])
    c = np.r_[np.zeros(2 * n), 1.0, np.full(t, 1 / (level * t)), np.zeros(t)]
    return bounded_simplex(linear_programme(c, a, np.r_[1.0, np.full(n, cap), np.ones(t)])[:n], cap)


def equal_weight(cov, mean, x, cap, policy, **_):
    return np.full(len(cov), 1 / len(cov))


def policy_book(cov, mean, x, cap, policy, **_):
    return np.array(policy)


FAMILIES = {
    "equal_weight": equal_weight, "policy": policy_book, "mean_variance": mean_variance, "minimum_variance": minimum_variance, "maximum_diversification": maximum_diversification,
    "erc": erc, "hierarchical_risk_parity": hierarchical_risk_parity, "mean_cvar": mean_cvar,
}


# Attribution and budget


def euler(weights: np.ndarray, cov: np.ndarray) -> dict:
    variance = float(weights @ cov @ weights)
    if variance <= 0:
        raise Refusal("a book without variance has no contributions")
    marginal = cov @ weights / math.sqrt(variance)
    return {"volatility": math.sqrt(variance), "marginal": marginal, "contribution": weights * marginal, "share": weights * marginal / math.sqrt(variance)}


def family_wise_bar(n: float, alpha: float = 0.05) -> float:
    return NormalDist().inv_cdf(1 - alpha / (2 * n))


POWER_QUANTILE = NormalDist().inv_cdf(0.8)


def detection(bar: float, power: float = 0.8) -> float:
    """Standard errors of the least difference that a test at ``bar`` finds with ``power``."""
    return bar + NormalDist().inv_cdf(power)
