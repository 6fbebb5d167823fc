"""Scores as column expressions. Constants are the semantics' own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def half_up(x: Column, digits: int) -> Column:
    """Rounding that every engine does alike: floor(x * 10**digits + 1/2)."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def significance(importance: Column, sources: Column, countries: Column) -> Column:
    """0 to 5: importance, and how widely a story is covered."""
    spread = 0.45 * F.log(1.0 + sources) / F.log(F.lit(2.0)) + 0.1 * F.least(F.greatest(countries - 1, F.lit(0)), F.lit(5))
    return half_up(F.least(F.lit(5.0), 0.4 * clamp(importance, 0.0, 5.0) + F.least(F.lit(3.0), spread)), 2)


def join_needs(base: float, size: Column) -> Column:
    """The similarity a story of this size asks of a new report; it grows with size, by at most 0.05."""
    return F.least(F.lit(base + 0.05), base + 0.015 * F.log2(F.greatest(size, F.lit(1))))


def merge_needs(base: float, size: Column) -> Column:
    """The same for merging stories; size is that of the smaller one."""
    return F.least(F.lit(base + 0.08), base + 0.015 * F.log2(F.greatest(size, F.lit(1))))


def band(sig: Column) -> Column:
    return F.when(sig >= 4, "top").when(sig >= 3, "high").when(sig >= 2, "medium").otherwise("low")


def channel_score(posts: Column, routed: Column, forwarded: Column, corroborated: Column, evaluable: Column, early: Column) -> Column:
    """0 to 100: how often a channel is right, early and on topic, and how little it forwards; priors for small counts."""
    s = 0.35 * (corroborated + 1) / (evaluable + 4) + 0.35 * (early + 0.5) / (corroborated + 3)
    s = s + 0.2 * (routed + 1) / (posts + 3) + 0.1 * (1 - F.coalesce(F.try_divide(forwarded, posts), F.lit(0.0)))
    return F.floor(1000.0 * s + 0.5) / 10.0  # not half_up(100 * s, 1): 100 * s * 10 may fall on the other side of a half


def towards_score(population: Column, off_degrees: Column, km: Column) -> Column:
    """How well a town fits as the aim of an arrow; null unless ahead, 2 to 40 km away and within 35 degrees."""
    fits = km.between(2, 40) & (off_degrees <= 35)
    return F.when(fits, F.log10(population + 10.0) - off_degrees / 60 - km / 80)
