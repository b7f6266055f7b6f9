"""Number, time and array functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(earlier: Column, later: Column) -> Column:
    """Days from one instant to another with their fractions; NULL if either is."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def within(at: Column, start: Column, end: Column) -> Column:
    """Whether an instant lies in [start, end); NULL lies in no window."""
    return F.coalesce((at >= start) & (at < end), F.lit(False))


def month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def decay(age_days: Column, half_life: float) -> Column:
    """Weight that halves each ``half_life`` days; 1 for what is not older than now."""
    return F.when(age_days <= 0, 1.0).otherwise(F.round(F.exp(F.lit(-math.log(2) / half_life) * age_days), 6))


def hub_damping(fan_in: Column) -> Column:
    """Less weight for what many depend on."""
    return 1 / (1 + F.log2(1 + fan_in.cast("double")))


def noisy_or(strength: Column) -> Column:
    """Aggregate: the chance that at least one of several independent pieces of evidence holds; NULL ones are no evidence."""
    return 1 - F.product(1 - F.coalesce(clamp(strength.cast("double"), 0.0, 1.0), F.lit(0.0)))


def concordance(own: Column, other: Column, q: float, p: float) -> Column:
    """How far ``own`` is at least as good as ``other``: 1 within indifference ``q``, 0 from preference ``p`` on, linear between."""
    gap = other - own
    return F.when(gap <= q, 1.0).when(gap >= p, 0.0).otherwise((p - gap) / (p - q) if p > q else F.lit(0.0))


def discordance(own: Column, other: Column, p: float, v: float) -> Column:
    """How far ``other`` speaks against ``own``: 0 within ``p``, 1 from veto ``v`` on, linear between."""
    gap = other - own
    return F.when(gap <= p, 0.0).when(gap >= v, 1.0).otherwise((gap - p) / (v - p) if v > p else F.lit(1.0))


def preference(gap: Column, q: float, p: float) -> Column:
    """Linear preference of a difference: 0 within ``q``, 1 from ``p`` on."""
    return F.when(gap <= q, 0.0).when(gap >= p, 1.0).otherwise((gap - q) / (p - q) if p > q else F.lit(1.0))


def differs(a: Column, b: Column, least: float, share: float) -> Column:
    """Whether two counts differ by more than ``least`` and by more than ``share`` of the greater; false if either is NULL."""
    gap = F.abs(a - b)
    return F.coalesce((gap > least) & (gap > share * F.greatest(a, b)), F.lit(False))


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` within [low, high]; NULL stays NULL (least and greatest alone would pass over it)."""
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def date_slices(start: Column, end: Column, days: int) -> Column:
    """Slices (slice_start, slice_end) of ``days`` days that cover [start, end], both inclusive."""
    first = F.sequence(start.cast("date"), end.cast("date"), F.expr(f"INTERVAL {days} DAYS"))
    return F.transform(first, lambda d: F.struct(d.alias("slice_start"), F.least(F.date_add(d, days - 1), end.cast("date")).alias("slice_end")))


def sorted_distinct(values: Column, most: int | None = None) -> Column:
    """Distinct values of an array in order, NULL left out, at most ``most``."""
    out = F.array_sort(F.array_distinct(F.array_compact(values)))
    return F.slice(out, 1, most) if most else out
