"""Arithmetic on 32-bit integers that wrap around, as Column expressions.

Arguments are int columns; null in, null out. Division and remainder by zero give 0, as Infinity and NaN have no
32-bit reading. Nothing here raises under ANSI mode.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_TURN = 16384


def wrap32(value: Column) -> Column:
    """The low 32 bits of a bigint as a signed int."""
    low = value.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 2**31, low - 2**32).otherwise(low).cast("int")


def truncated(value: Column) -> Column:
    """A double cut toward zero and wrapped; what is not finite, and what no bigint holds, gives 0."""
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
    return wrap32(F.when(F.isnan(value) | (F.abs(value) >= 2.0**62), F.lit(0)).otherwise(whole))


def _long(x: Column) -> Column:
    return x.cast("bigint")


def add(a: Column, b: Column) -> Column:
    return wrap32(_long(a) + _long(b))


def sub(a: Column, b: Column) -> Column:
    return wrap32(_long(a) - _long(b))


def mul(a: Column, b: Column) -> Column:
    """Exact below 2^53, which is where a double product is exact as well."""
    return wrap32(_long(a) * _long(b))


def div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0)).otherwise(truncated(a.cast("double") / F.when(b != 0, b.cast("double")))).cast("int")


def mod(a: Column, b: Column) -> Column:
    """Sign of the dividend."""
    return F.when(b == 0, F.lit(0)).otherwise(wrap32(_long(a) % F.when(b != 0, _long(b)))).cast("int")


def interpolate(y0: Column, y1: Column, x0: Column, x1: Column, x: Column) -> Column:
    """The slope is rounded down before it is multiplied; 0 where x0 = x1."""
    slope = F.floor((_long(y1) - _long(y0)) / F.when(x1 != x0, (_long(x1) - _long(x0)).cast("double")))
    return F.when(x1 == x0, F.lit(0)).otherwise(wrap32(slope * (_long(x) - _long(x0)) + _long(y0))).cast("int")


def add_percent(n: Column, percent: Column) -> Column:
    return truncated(_long(n) * _long(percent) / F.lit(100.0) + n)


def scale(a: Column, b: Column, c: Column) -> Column:
    """a * c / b, cut toward zero."""
    return F.when(b == 0, F.lit(0)).otherwise(truncated((_long(a) * _long(c)).cast("double") / F.when(b != 0, b.cast("double")))).cast("int")


def power(a: Column, b: Column) -> Column:
    return truncated(F.pow(a.cast("double"), b.cast("double")))


def root(a: Column, b: Column) -> Column:
    """The b-th root cut toward zero; 0 if either is 0."""
    whole = F.when(b == 1, a.cast("double")).when(b == 2, F.sqrt(a.cast("double"))).when(b == 3, F.cbrt(a.cast("double"))).when(b == 4, F.sqrt(F.sqrt(a.cast("double"))))
    other = F.pow(a.cast("double"), F.lit(1.0) / F.when(b != 0, b.cast("double")))
    return F.when((a == 0) | (b == 0), F.lit(0)).otherwise(truncated(F.coalesce(whole, other))).cast("int")


def _bit(n: Column) -> Column:
    """1 shifted by the low five bits of n."""
    return wrap32(F.pow(F.lit(2.0), n.bitwiseAND(F.lit(31)).cast("double")).cast("bigint"))


def set_bit(a: Column, n: Column) -> Column:
    return a.bitwiseOR(_bit(n))


def clear_bit(a: Column, n: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(_bit(n)))


def toggle_bit(a: Column, n: Column) -> Column:
    return a.bitwiseXOR(_bit(n))


def test_bit(a: Column, n: Column) -> Column:
    return (a.bitwiseAND(_bit(n)) != 0).cast("int")


def bit_count(a: Column) -> Column:
    return F.bit_count(_long(a).bitwiseAND(F.lit(0xFFFFFFFF)))


def range_mask(first: int, last: int) -> int:
    """Bits first to last, both in it, as a signed 32-bit number."""
    mask = ((1 << (last - first + 1)) - 1) << first & 0xFFFFFFFF
    return mask - 2**32 if mask >= 2**31 else mask


def set_bits(a: Column, first: int, last: int) -> Column:
    return a.bitwiseOR(F.lit(range_mask(first, last)))


def clear_bits(a: Column, first: int, last: int) -> Column:
    return a.bitwiseAND(F.lit(~range_mask(first, last)))


def get_bits(a: Column, first: int, last: int) -> Column:
    low = _long(a).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(low, first).bitwiseAND(F.lit((1 << (last - first + 1)) - 1)).cast("int")


def put_bits(a: Column, value: Column, first: int, last: int) -> Column:
    """value, at most what the bits can hold, written into bits first to last."""
    most = (1 << (last - first + 1)) - 1
    return clear_bits(a, first, last).bitwiseOR(wrap32(_long(F.least(value, F.lit(min(most, 2**31 - 1)))) * (1 << first)))


def sine(a: Column) -> Column:
    """16384 steps make a full turn, and 1 is written 16384."""
    return (F.sin(a.bitwiseAND(F.lit(FULL_TURN - 1)) * (2 * math.pi / FULL_TURN)) * FULL_TURN).cast("int")


def cosine(a: Column) -> Column:
    return (F.cos(a.bitwiseAND(F.lit(FULL_TURN - 1)) * (2 * math.pi / FULL_TURN)) * FULL_TURN).cast("int")


def angle(y: Column, x: Column) -> Column:
    turn = F.floor(F.atan2(y.cast("double"), x.cast("double")) * (FULL_TURN / (2 * math.pi)) + 0.5)
    return turn.bitwiseAND(F.lit(FULL_TURN - 1)).cast("int")


def absolute(a: Column) -> Column:
    return wrap32(F.abs(_long(a)))
