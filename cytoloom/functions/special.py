"""Tail probabilities, written out because no statistics library is at hand."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    log = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(log)
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * math.exp(log)


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric_upper(k: int, total: int, marked: int, drawn: int) -> float:
    """Chance of k or more marked among drawn."""
    top = min(marked, drawn)
    return min(1.0, sum(math.exp(log_choose(marked, i) + log_choose(total - marked, drawn - i) - log_choose(total, drawn)) for i in range(max(k, drawn - (total - marked), 0), top + 1)))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of the tables no likelier than the one seen, margins fixed."""
    row, col, total = a + b, a + c, a + b + c + d
    chance = {i: math.exp(log_choose(row, i) + log_choose(total - row, col - i) - log_choose(total, col)) for i in range(max(0, col - (total - row)), min(row, col) + 1)}
    return min(1.0, sum(p for p in chance.values() if p <= chance[a] * (1 + 1e-7)))


def signed_rank_two_sided(w: float, n: int) -> float:
    """Exact for up to 50 differences whose ranks are whole, else the normal approximation without correction."""
    if n < 1:
        return float("nan")
    top = n * (n + 1) // 2
    if n <= 50 and float(w).is_integer():
        ways = [1] + [0] * top
        for r in range(1, n + 1):
            for s in range(top, r - 1, -1):
                ways[s] += ways[s - r]
        low = min(int(w), top - int(w))
        return min(1.0, 2 * sum(ways[: low + 1]) / 2**n)
    return 2 * normal_upper(abs(w - top / 2) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24))
