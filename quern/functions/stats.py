"""Changes of a level by a constant and a per cent share; parts of a point are cut off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 255


def _change(of: Column, constant: Column, percent: Column) -> Column:
    return (constant + of * percent / 100).cast("int")


def stat_add(base: Column, now: Column, constant: Column, percent: Column) -> Column:
    return F.least(now + _change(base, constant, percent), F.lit(MOST))


def stat_sub(base: Column, now: Column, constant: Column, percent: Column) -> Column:
    return F.greatest(now - _change(base, constant, percent), F.lit(0))


def stat_boost(base: Column, now: Column, constant: Column, percent: Column) -> Column:
    """Up to the base and the boost together, never down."""
    boost = _change(base, constant, percent)
    return F.least(F.greatest(F.least(now + boost, base + boost), now), F.lit(MOST))


def stat_drain(base: Column, now: Column, constant: Column, percent: Column) -> Column:
    """The share is of the level as it is now."""
    return F.greatest(now - _change(now, constant, percent), F.lit(0))


def stat_heal(base: Column, now: Column, constant: Column, percent: Column) -> Column:
    """Up to the base, never down."""
    return F.greatest(F.least(now + _change(base, constant, percent), base), now)
