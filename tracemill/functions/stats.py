"""P-values: small helpers on aggregated rows, one row per test."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import cache

import pandas as pd
from pyspark.sql.functions import pandas_udf


@cache
def _denumerant(few: int) -> tuple[int, tuple[int, ...]]:
    """(period, numerator) of 1 / ((1 - q)(1 - q)(1 - q^2) ... (1 - q^few)), written over (1 - q^period)^(few + 1)."""
    period, top = math.lcm(*range(1, few + 1)), [1]
    for part in [1, *range(1, few + 1)]:
        wide = [0] * (len(top) + period - part)
        for shift in range(0, period, part):
            for i, x in enumerate(top):
                wide[shift + i] += x
        top = wide
    return period, tuple(top)


def _up_to(m: int, few: int) -> int:
    """How many sequences of ``few`` multiplicities of 1, 2 ... few sum to ``m`` at most."""
    if m < 0:
        return 0
    period, top = _denumerant(few)
    return sum(top[j] * math.comb((m - j) // period + few, few) for j in range(m % period, min(len(top), m + 1), period))


def count_at_most(k: int, few: int, many: int) -> int:
    """Ways in which U of ``few`` values among ``many`` others is at most ``k``, without ties: an exact integer.

    The generating function is the product of (1 - q^(many + i)) / (1 - q^i) for i = 1 .. few. Its numerator has at
    most 2^few terms, and sums of the coefficients of what is left follow from a few binomials each, whatever the sizes.
    """
    terms = {0: 1}
    for i in range(1, few + 1):
        for e, x in list(terms.items()):
            terms[e + many + i] = terms.get(e + many + i, 0) - x
    return sum(x * _up_to(k - e, few) for e, x in terms.items())


def exact_u_tail(u: float, n1: int, n2: int) -> float:
    """Two-sided exact probability of a U at least as far from its mean, without ties, in time and memory that don't grow with the larger group."""
    few, many = sorted((n1, n2))
    low = math.floor(min(u, n1 * n2 - u) + 1e-9)  # by symmetry the lower tail
    return float(min(Fraction(1), Fraction(2 * count_at_most(low, few, many), math.comb(n1 + n2, few))))


def mann_whitney_p(u: float, n1: int, n2: int, ties: float) -> float:
    """P of a two-sided test from U, the group sizes and the sum of t^3 - t over ties.

    1 if a group has fewer than two values. Exact if the smaller group has at most 8 values and there is no tie; else
    the normal approximation with tie and continuity corrections.
    """
    n1, n2 = int(n1), int(n2)
    if min(n1, n2) < 2:
        return 1.0
    if min(n1, n2) <= 8 and ties == 0:
        return exact_u_tail(u, n1, n2)
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    high = max(u, n1 * n2 - u)
    return min(1.0, math.erfc((high - n1 * n2 / 2 - 0.5) / math.sqrt(2 * var)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def spearman_p(rho: float, n: int) -> float:
    """P of a rank correlation from Student's t with n - 2 degrees of freedom."""
    if n < 3:
        return 1.0
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def mann_whitney_p_udf():
    """A pandas UDF of (u, n1, n2, ties)."""

    @pandas_udf("double")
    def p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([mann_whitney_p(*x) for x in zip(u, n1, n2, ties)], dtype=float)

    return p


def spearman_p_udf():
    """A pandas UDF of (rho, n)."""

    @pandas_udf("double")
    def p(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([spearman_p(r, int(k)) for r, k in zip(rho, n)], dtype=float)

    return p
