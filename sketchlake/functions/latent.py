"""Fractions of a reference that is present, behind the breadth that reads happen to show.

Every solver is a column: a one-dimensional search folded over a fixed number of
steps, so a row costs the same wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of the search grid, halvings of the rate search and its upper end.
GRID, HALVINGS, RATE_MAX = 512, 80, 1e6


def _clean(x: Column) -> Column:
    """Null and not-a-number count as 0."""
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(0.0)).otherwise(x.cast("double"))


def truncated_rate(mean_positive: Column) -> Column:
    """The rate of the zero-truncated Poisson whose mean is that of the positive counts; 0 without counts, 1e-10 for means up to 1.

    The mean exceeds the rate, and the rate exceeds the mean less one, so the search starts between them.
    """
    m = _clean(mean_positive)
    start = F.struct(F.greatest(m - 1.0, F.lit(1e-10)).alias("lo"), F.least(m, F.lit(RATE_MAX)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) * 0.5
        low = mid / (1 - F.exp(-mid)) < m
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, step, lambda s: (s["lo"] + s["hi"]) * 0.5)
    return F.when(m <= 0, F.lit(0.0)).when(m <= 1 + 1e-10, F.lit(1e-10)).otherwise(found)


def truncated_fraction(breadth: Column, mean_positive: Column) -> Column:
    """Breadth over the chance that a present context was seen at all, at most 1."""
    b, rate = _clean(breadth), truncated_rate(mean_positive)
    seen = 1 - F.exp(-rate)
    return F.when(b <= 0, F.lit(0.0)).when(seen <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), b / F.when(seen > 0, seen).otherwise(F.lit(1.0))))


def _zero_share(x: Column, rate: Column, variance: Column | None, mean: Column) -> Column:
    """The chance that a present context has no count, if the fraction ``x`` is present at ``rate`` = mean / x.

    Poisson: exp(-rate). Negative binomial: (k / (k + rate)) ** k, where the moments of the mixture give 1 / k = (variance - mean) x / mean**2 - (1 - x);
    null where that isn't positive.
    """
    if variance is None:
        return F.exp(-rate)
    spread = (variance - mean) * x / (mean * mean) - (1 - x)
    return F.when(spread > 1e-9, F.exp(-F.log1p(rate * spread) / spread))


def _on_grid(breadth: Column, mean: Column, variance: Column | None = None) -> Column:
    """The grid point x between the breadth and 1 at which x (1 - zero share) comes nearest to the breadth.

    The expected breadth rises with x (more contexts, each at a lower rate) up to a single crossing, so the last grid point that doesn't exceed the observed
    breadth is bracketed by halving the grid's numbers; it or the next one is nearest. Points without a dispersion lie below all others and count as not exceeding.
    """
    b, m = F.least(F.greatest(_clean(breadth), F.lit(0.0)), F.lit(1.0)), F.greatest(_clean(mean), F.lit(0.0))
    v = None if variance is None else F.greatest(_clean(variance), F.lit(0.0))
    point = lambda i: b + (1 - b) * (i.cast("double") / F.lit(float(GRID - 1)))
    gap = lambda i: point(i) * (1 - _zero_share(point(i), m / point(i), v, m)) - b

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        under = F.coalesce(gap(mid) <= 0, F.lit(True))
        return F.struct(F.when(under, mid).otherwise(s["lo"]).alias("lo"), F.when(under, s["hi"]).otherwise(mid - 1).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(GRID - 1).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit((GRID - 1).bit_length()))
    at = F.aggregate(steps, start, halve, lambda s: s["lo"])

    def nearer(i: Column) -> Column:
        after = F.least(i + 1, F.lit(GRID - 1))
        here, there = F.abs(gap(i)), F.abs(gap(after))
        return F.when(here.isNull() & there.isNull(), b).when(there.isNull() | (here <= there), point(i)).otherwise(point(after))

    usable = (b > 0) & (b < 1) & (m > 0) if v is None else (b > 0) & (b < 1) & (m > 0) & (v > m)
    return F.when(usable, nearer(at)).otherwise(b)


def poisson_grid(breadth: Column, mean: Column) -> Column:
    """The zero-inflated Poisson fraction on the grid; the breadth itself where it is 0 or 1, or without depth."""
    return _on_grid(breadth, mean)


def negative_binomial_grid(breadth: Column, mean: Column, variance: Column) -> Column:
    """The zero-inflated negative binomial fraction on the grid, by moments; the breadth where the variance doesn't exceed the mean or no point has a dispersion."""
    return _on_grid(breadth, mean, variance)


def density(threshold: Column, hash_bits: int) -> Column:
    """The share of all contexts that a hash threshold lets through."""
    return (threshold.cast("double") + 1.0) / F.lit(float(2**hash_bits))


def trackable(possible_contexts: Column, share: Column) -> Column:
    """The chance that a read with so many contexts keeps at least one at this density."""
    p, n = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), possible_contexts.cast("double")
    return F.when((n <= 0) | (p <= 0), F.lit(0.0)).when(p >= 1, F.lit(1.0)).otherwise(-F.expm1(n * F.log1p(-F.when(p < 1, p).otherwise(F.lit(0.0)))))
