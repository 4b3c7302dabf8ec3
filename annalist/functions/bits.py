"""Bit operations on BIGINT words whose distance may be a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def shl(word, by) -> Column:
    return F.call_function("shiftleft", _lit(word), _lit(by).cast("int"))


def shr(word, by) -> Column:
    """Arithmetic shift, the floor of a division by a power of two."""
    return F.call_function("shiftright", _lit(word), _lit(by).cast("int"))


def ushr(word, by) -> Column:
    return F.call_function("shiftrightunsigned", _lit(word), _lit(by).cast("int"))


def has_bit(word, at) -> Column:
    return ushr(word, at).bitwiseAND(F.lit(1)) == 1
