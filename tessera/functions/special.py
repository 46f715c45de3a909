"""Normal and chi-square functions in plain Python and numpy."""

from __future__ import annotations

import math


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of normal_cdf, by bisection to the last bits."""
    if not 0 < p < 1:
        raise ValueError("a probability strictly between 0 and 1 is needed")
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def chi_square_tail(x: float, k: int) -> float:
    """P(X > x) for an even number k of degrees of freedom: a Poisson sum."""
    if k % 2:
        raise ValueError("even degrees of freedom are needed")
    term = total = math.exp(-x / 2)
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return min(1.0, total)


def fisher_p(ps: list[float]) -> float:
    """Fisher's combination of independent p-values."""
    return chi_square_tail(-2 * sum(math.log(max(p, 1e-300)) for p in ps), 2 * len(ps)) if ps else 1.0


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # the fraction from its far end: 1 / (1 + d1 / (1 + d2 / (1 + ...)))
    value = 1.0
    for i in range(400, 0, -1):
        m = i // 2
        d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + d / value
    return min(1.0, front / value)


def beta_quantile(p: float, a: float, b: float) -> float:
    """Inverse of beta_cdf by bisection."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def fisher_g_p(g: float, m: int) -> float:
    """Chance, at most, that white noise puts a share g of its power or more into one of m bins.

    A given bin holds that much with probability (1 - g)^(m - 1); the bound is the sum over the bins, in logs.
    """
    if m < 2 or g >= 1:
        return float(m < 2)
    return math.exp(min(0.0, math.log(m) + (m - 1) * math.log1p(-max(g, 0.0))))


def fisher_g_critical(m: int, alpha: float) -> float:
    """Share of the power that white noise exceeds in any of m bins with probability alpha at most; 1 for a lone bin."""
    return -math.expm1((math.log(alpha) - math.log(m)) / (m - 1)) if m > 1 else 1.0


def gamma_tail_log(a: float, x: float) -> float:
    """log of the upper regularised incomplete gamma function: its series under a + 1, else its continued fraction."""
    if x <= 0:
        return 0.0
    front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return math.log1p(-min(1 - 1e-16, math.exp(front) * total))
    steps = 200 + int(20 * math.sqrt(a))
    value = x + 2 * steps + 1 - a
    for n in range(steps, 0, -1):
        value = x + 2 * n - 1 - a - n * (n - a) / value
    return front - math.log(value)


def gamma_tail_z(a: float, x: float) -> float:
    """Normal score of the upper tail of a gamma variable; by Wilson and Hilferty's cube root where the tail underflows."""
    tail = gamma_tail_log(a, x)
    if tail < -690:
        wide = 1 / (9 * a)
        return ((x / a) ** (1 / 3) - (1 - wide)) / math.sqrt(wide)
    return -normal_quantile(min(math.exp(tail), 1 - 1e-16))
