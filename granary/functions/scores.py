"""Scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of doubles; null if one is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def rrf(rank: Column, k: int = RRF_K) -> Column:
    """A ranking's contribution, with ranks from 0; nothing for a missing rank."""
    return F.coalesce(1.0 / (rank + F.lit(k + 1)), F.lit(0.0))


def decay(age_days: Column, half_life: float) -> Column:
    """Half for each half-life; negative ages count as none."""
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)


def age_days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86_400e6


def engagement_multiplier(opens: Column, useful: Column, irrelevant: Column, a: float = 0.05, b: float = 0.1) -> Column:
    return F.least(F.lit(1.25), F.greatest(F.lit(0.8), 1 + a * F.log1p(opens) + b * (useful - irrelevant)))


def resurface(age: Column, since_access: Column, tags: Column, has_summary: Column, h1: float = 180.0, h2: float = 90.0) -> Column:
    return (1 - decay(age, h1)) * (1 - decay(since_access, h2)) * (1 + 0.1 * tags + 0.2 * has_summary)


def lift(both: Column, a: Column, b: Column) -> Column:
    """Shared documents over those of the rarer side."""
    return both / F.least(a, b)


def dcg_gain(rank: Column) -> Column:
    """Gain of a relevant row at a rank from 1."""
    return 1 / F.log2(rank + 1)
