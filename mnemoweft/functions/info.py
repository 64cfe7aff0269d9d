"""Information and decay."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FILL = 1e-10


def clamp(w: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))


def pmi(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """ln(p_ab / (p_a p_b)); 0 where a count is 0 or missing."""
    x, a, b, t = (c.cast("double") for c in (n_ab, n_a, n_b, n))
    return F.when((x > 0) & (a > 0) & (b > 0) & (t > 0), F.ln(x * t / (a * b))).otherwise(F.lit(0.0))


def npmi(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """pmi / -ln p_ab; 0 where a count is 0 or missing or p_ab is 1.

    The joint count may be of soft, the single ones of hard memberships; then it can exceed 1.
    """
    x, t = n_ab.cast("double"), n.cast("double")
    return F.when((x > 0) & (x != t) & (t > 0), pmi(n_ab, n_a, n_b, n) / -F.ln(x / t)).otherwise(F.lit(0.0))


def log_likelihood_ratio(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Dunning's G2 of the two-by-two table."""
    x, a, b, t = (c.cast("double") for c in (n_ab, n_a, n_b, n))
    term = lambda o, e: F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(F.lit(0.0))
    return 2 * (
        term(x, a * b / t) + term(a - x, a * (t - b) / t) + term(b - x, (t - a) * b / t) + term(t - a - b + x, (t - a) * (t - b) / t)
    )


def half_life(then: Column, as_of: Column, days: float) -> Column:
    """Factor of decay between two timestamps."""
    gone = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 86_400e6
    return F.exp(F.lit(-math.log(2) / days) * gone)


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence (natural log) of two maps of weights; gaps count as 1e-10."""
    keys = F.array_union(F.map_keys(p), F.map_keys(q))
    weight = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(FILL)).cast("double")
    total = lambda m: F.aggregate(keys, F.lit(0.0), lambda s, k: s + weight(m, k))
    sp, sq = total(p), total(q)

    def term(s, k):
        x, y = weight(p, k) / sp, weight(q, k) / sq
        m = (x + y) / 2
        return s + 0.5 * x * F.ln(x / m) + 0.5 * y * F.ln(y / m)

    return F.aggregate(keys, F.lit(0.0), term)


def poincare_distance(a: Column, b: Column) -> Column:
    """Hyperbolic distance of two points inside the unit ball."""
    from mnemoweft.functions.vector import dot

    gap = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x - y)
    return F.acosh(1 + 2 * dot(gap, gap) / ((1 - dot(a, a)) * (1 - dot(b, b))))
