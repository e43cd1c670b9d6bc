"""Distribution functions for test statistics, from Python's math alone; they act on a handful of numbers on the driver."""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of chi-squared: series below the mean, continued fraction above."""
    if x <= 0:
        return 1.0
    a, h = k / 2, x / 2
    front = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= h / n
            total += term
        return 1 - total * front
    b, c = h + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return out * front


def kolmogorov_sf(d: float, n: int) -> float:
    """Asymptotic upper tail of the one-sample Kolmogorov-Smirnov distance."""
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def holm(p: list[float]) -> list[float]:
    """Step-down corrected p-values, in the order given."""
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, most = [0.0] * len(p), 0.0
    for k, i in enumerate(order):
        most = max(most, min(1.0, (len(p) - k) * p[i]))
        out[i] = most
    return out
