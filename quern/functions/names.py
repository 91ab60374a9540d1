"""Names of up to twelve characters as base-37 numbers: 1-26 letters, 27-36 digits, 0 anything else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the character of each digit.
ALPHABET = "_abcdefghijklmnopqrstuvwxyz0123456789"
LIMIT = 37**12
HALF = 37**6


def encode(name: Column) -> Column:
    """bigint; letters without case, only the first twelve characters count."""
    letters = F.filter(F.split(F.substring(F.lower(F.trim(name)), 1, 12), ""), lambda c: F.length(c) > 0)
    return F.aggregate(letters, F.lit(0).cast("bigint"), lambda acc, c: acc * 37 + F.greatest(F.instr(F.lit(ALPHABET), c) - 1, F.lit(0)).cast("bigint"))


def decode(number: Column) -> Column:
    """The name; ``invalid_name`` for numbers out of range and those that end in a zero digit.

    The number is split in two halves of six digits, which are small enough for exact double division.
    """
    low = F.pmod(number, F.lit(HALF))
    high = F.round((number - low) / F.lit(HALF))
    digits = [F.floor(half / F.lit(float(37**i))).cast("bigint") % 37 for half in (high, low) for i in range(5, -1, -1)]
    text = F.concat(*[F.substring(F.lit(ALPHABET), d.cast("int") + 1, F.lit(1)) for d in digits])
    return F.when((number < 0) | (number >= F.lit(LIMIT)) | (number % 37 == 0), "invalid_name").otherwise(F.regexp_replace(text, "^_+", ""))


def display(name: Column) -> Column:
    """Each word with a capital, as the name reads after it was encoded."""
    return F.initcap(F.translate(decode(encode(name)), "_", " "))
