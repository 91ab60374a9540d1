"""Packed grid coordinates: level in bits 28-29, x in bits 14-27, z in bits 0-13 of an int."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE_BITS = 3  # a zone is 8 by 8 tiles
SQUARE_BITS = 6  # a map square is 64 by 64 tiles


def pack(level: Column, x: Column, z: Column) -> Column:
    return F.shiftleft(level.bitwiseAND(F.lit(3)), 28).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(0x3FFF)), 14)).bitwiseOR(z.bitwiseAND(F.lit(0x3FFF)))


def level_of(c: Column) -> Column:
    return F.shiftright(c, 28).bitwiseAND(F.lit(3))


def x_of(c: Column) -> Column:
    return F.shiftright(c, 14).bitwiseAND(F.lit(0x3FFF))


def z_of(c: Column) -> Column:
    return c.bitwiseAND(F.lit(0x3FFF))


def move(c: Column, dx: Column, dlevel: Column, dz: Column) -> Column:
    return pack(level_of(c) + dlevel, x_of(c) + dx, z_of(c) + dz)


def distance(a: Column, b: Column) -> Column:
    """Chebyshev: the larger of the two axis distances."""
    return F.greatest(F.abs(x_of(a) - x_of(b)), F.abs(z_of(a) - z_of(b)))


def in_box(c: Column, low: Column, high: Column) -> Column:
    return level_of(c).between(level_of(low), level_of(high)) & x_of(c).between(x_of(low), x_of(high)) & z_of(c).between(z_of(low), z_of(high))


def zone(axis: Column) -> Column:
    return F.shiftright(axis, ZONE_BITS)


def map_square(axis: Column) -> Column:
    return F.shiftright(axis, SQUARE_BITS)
