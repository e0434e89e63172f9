"""Tail probabilities of test statistics. They act on a handful of scalars per column, never on
rows of a table: continued fractions and series as published in the usual handbooks."""

from __future__ import annotations

import math


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1 - a
    g = 1.0 / 1e-300
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        g = b + an / g
        g = 1e-300 if abs(g) < 1e-300 else g
        d = 1.0 / d
        h *= d * g
        if abs(d * g - 1) < 1e-15:
            break
    return min(1.0, front * h)


def chi2_sf(stat: float, dof: float) -> float:
    return gamma_q(dof / 2.0, stat / 2.0)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    tiny = 1e-300
    cc, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            cc = 1 + num / cc
            cc = cc if abs(cc) > tiny else tiny
            h *= d * cc
        if abs(d * cc - 1) < 1e-15:
            break
    return front * h / a


def f_sf(stat: float, d1: float, d2: float) -> float:
    """P(F > stat)."""
    if stat <= 0:
        return 1.0
    return beta_i(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * stat))


def kolmogorov_sf(t: float) -> float:
    """Tail of the Kolmogorov distribution."""
    if t <= 0:
        return 1.0
    if t < 1.18:
        y = math.exp(-math.pi ** 2 / (8 * t * t))
        return 1.0 - math.sqrt(2 * math.pi) / t * (y + y ** 9 + y ** 25 + y ** 49)
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


#: sizes up to which the two-sample distribution is counted exactly; its cost is their product
EXACT_KS = 10_000


def ks_2samp_exact_sf(stat: float, n: int, m: int) -> float:
    """P(D >= stat) of two samples without ties, from lattice paths.

    A path from (0, 0) to (n, m) is one order of the pooled sample, each as likely as any other. Step by
    step ``here`` holds the probability of having taken i values of the first sample without having left
    the band around the diagonal; what leaves it adds up to the result, so small ones keep their digits."""
    import numpy as np

    if stat <= 0:
        return 1.0
    band = (math.floor(stat * n * m - 1e-7) + 0.5) / (n * m)
    here, left = np.zeros(n + 2), 0.0  # entry i + 1 belongs to i
    here[1] = 1.0
    for t in range(1, n + m + 1):
        # neighbours of all places that can be inside before this step
        lo = max(0, math.floor(((t - 1) / m - band) / (1 / n + 1 / m)) - 1)
        hi = min(n, math.ceil((t / m + band) / (1 / n + 1 / m)) + 1)
        i = np.arange(lo, hi + 1)
        rest = n + m - t + 1
        step = here[lo + 1 : hi + 2] * np.maximum(m - (t - 1 - i), 0) / rest + here[lo : hi + 1] * np.maximum(n - i + 1, 0) / rest
        out = np.abs(i / n - (t - i) / m) > band
        left += step[out].sum()
        step[out] = 0.0
        here[lo + 1 : hi + 2] = step
    return float(min(1.0, left))


def ks_2samp_sf(stat: float, n: int, m: int) -> float:
    """Two-sample p-value: exact up to EXACT_KS values a side, beyond that asymptotic with the
    finite-sample correction of Stephens."""
    n, m = int(n), int(m)
    root = math.sqrt(n * m / (n + m))
    far = kolmogorov_sf((root + 0.12 + 0.11 / root) * stat)
    # far out in the tail both are 0 in all digits that are ever shown
    return ks_2samp_exact_sf(stat, n, m) if max(n, m) <= EXACT_KS and far > 1e-12 else far
