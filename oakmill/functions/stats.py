"""Sample sizes and confidence bounds. The driver works on a few moments; nothing here touches rows."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return max(0.0, 1 - scale * h)


def chi2_ppf(p: float, df: float) -> float:
    """Quantile of the chi-square distribution, by bisection from the Wilson-Hilferty guess."""
    if not 0 < p < 1 or df <= 0:
        raise ValueError("a probability and degrees of freedom above 0 are needed")
    guess = df * max(1e-8, (1 - 2 / (9 * df) + normal_ppf(p) * math.sqrt(2 / (9 * df)))) ** 3
    low, high = guess, guess
    while _gamma_p(df / 2, low / 2) > p:
        low /= 1.1
    while _gamma_p(df / 2, high / 2) < p:
        high = high * 1.1 + 1e-12
    for _ in range(200):
        mid = (low + high) / 2
        if _gamma_p(df / 2, mid / 2) < p:
            low = mid
        else:
            high = mid
        if high - low <= 1e-13 * max(1.0, high):
            break
    return (low + high) / 2


def lambert_w(z: float) -> float:
    """The principal branch for z >= -1/e, by Halley's steps."""
    if z < -1 / math.e - 1e-12:
        raise ValueError("no real value below -1/e")
    w = math.log1p(z) if z > -0.3 else -1 + math.sqrt(max(0.0, 2 * (math.e * z + 1)))
    if z > math.e:
        w = math.log(z) - math.log(math.log(z))
    for _ in range(100):
        e = math.exp(w)
        f = w * e - z
        slope = e * (w + 1)
        if slope == 0:
            break
        step = f / (slope - (w + 2) * f / (2 * w + 2)) if w != -1 else f / slope
        w -= step
        if abs(step) < 1e-14 * (1 + abs(w)):
            break
    return w


@dataclass(frozen=True)
class Moments:
    """Of the statistic of sampled blobs (or, for a mean, of rows): how many, sum, sum of squares, greatest size."""

    n: float
    total: float
    squares: float
    most: float

    @property
    def mean(self) -> float:
        return self.total / self.n if self.n else 0.0

    @property
    def std(self) -> float:
        return math.sqrt(max(0.0, self.squares / self.n - self.mean**2)) if self.n else 0.0


def std_upper(m: Moments, delta: float) -> float:
    """Upper confidence bound of the standard deviation, by the chi-square distribution."""
    if m.n < 2 or m.std == 0:
        return m.std
    return m.std * math.sqrt(m.n - 1) / math.sqrt(chi2_ppf(delta / 2, m.n - 1))


def bennett(m: Moments, delta: float) -> float:
    """Half width of the confidence interval of a mean by Bennett's inequality; 0 where nothing varies.

    Solves n V / a^2 h(a t / V) = ln(2 / delta), h(u) = (1 + u) ln(1 + u) - u, which is a Lambert W expression.
    """
    variance, a = std_upper(m, delta) ** 2, m.most
    if variance <= 1e-300 or a == 0 or m.n == 0:
        return 0.0
    x = a * a * math.log(2 / delta) / (m.n * variance)
    u = math.exp(lambert_w((x - 1) / math.e) + 1) - 1
    return variance / a * u


def proportion_lower(hits: float, n: float, delta: float) -> float:
    """Lower end of the normal-approximation interval of a proportion."""
    p = min(1.0, hits / n)
    return p + normal_ppf(delta / 2) * math.sqrt(p * (1 - p) / n)


def required(m: Moments, error: float, delta: float, share: float = 1.0) -> int | None:
    """Blobs to sample for a relative error, or None where the pilot can't tell (exact evaluation is due).

    ``share`` is a lower bound of the share of blobs that have the statistic at all.
    """
    lower = abs(m.mean) - bennett(m, delta)
    if m.n == 0 or lower <= 0 or share <= 0:
        return None
    if m.std == 0:
        return 0
    return int((normal_ppf(delta / 2) * std_upper(m, delta) / (error * lower)) ** 2 / share) + 1


def mean_error(error: float) -> float:
    """A ratio of two estimates is within ``error`` if each is within this."""
    return min(1 - math.sqrt(1 - error), math.sqrt(1 + error) - 1)


def recall_target(above: Moments, below: Moments, draws: int, confidence: float) -> float:
    """The target on the sample that keeps a recall target with this confidence (in percent), from moments of masses of
    matching draws above and below the threshold (zero for other draws)."""
    delta = (1 - confidence / 100) / 2
    spread = math.sqrt(2 * math.log(1 / delta) / draws)
    upper = above.mean + above.std * spread
    lower = max(0.0, below.mean - below.std * spread)
    return upper / (upper + lower) if upper + lower > 0 else 1.0
