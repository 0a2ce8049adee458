"""Numeric kernels that Spark has no function for; scalars and small vectors only."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(40)


def normal_cdf(x: float) -> float:
    return _NORMAL.cdf(x)


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def joint_default(p: float, rho: float) -> float:
    """P(X < c, Y < c) of two standard normals with correlation rho, c the quantile of p: Plackett's integral by Gauss-Legendre."""
    h = normal_quantile(p)
    r = rho * (_NODES + 1) / 2
    density = np.exp(-h * h / (1 + r)) / (2 * math.pi * np.sqrt(1 - r * r))
    return p * p + float(rho / 2 * (_WEIGHTS * density).sum())


def asset_correlation(p: float, p11: float) -> float | None:
    """The correlation at which two events of probability p are joint with probability p11; bisection, clamped at both ends."""
    if not 0 < p < 1:
        return None
    low, high = 1e-6, 0.999
    if p11 <= joint_default(p, low):
        return 0.0
    if p11 >= joint_default(p, high):
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if joint_default(p, mid) < p11 else (low, mid)
    return (low + high) / 2


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-30)
        c = 1 + top / c or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def beta_quantile(q: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < q else (low, mid)
    return (low + high) / 2


def exact_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper and Pearson's interval of a rate."""
    tail = (1 - level) / 2
    return (beta_quantile(tail, k, n - k + 1) if k else 0.0, beta_quantile(1 - tail, k + 1, n - k) if k < n else 1.0)


def binomial_cdf(k: int, n: int, p: float) -> float:
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    return 1 - beta_cdf(p, k + 1, n - k)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact test of a two-by-two table."""
    n, row, col = a + b + c + d, a + b, a + c
    log_choose = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    prob = lambda x: math.exp(log_choose(row, x) + log_choose(n - row, col - x) - log_choose(n, col))
    own = prob(a)
    return min(1.0, sum(p for x in range(max(0, row + col - n), min(row, col) + 1) if (p := prob(x)) <= own * (1 + 1e-7)))


def pool_adjacent(levels: list[tuple[float, float]]) -> list[float]:
    """The non-decreasing fit of (value, weight) levels of least weighted squares."""
    blocks: list[list[float]] = []
    for value, weight in levels:
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v, w, n = blocks.pop()
            u = blocks[-1]
            u[0], u[1], u[2] = (u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + n
    return [v for v, _, n in blocks for _ in range(int(n))]
