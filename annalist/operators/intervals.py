"""Covered periods and gaps of overlapping, nested and gapped intervals.

Time is counted in exact whole units (days). The units an entity covers are kept as a compressed bitmap of 64-bit words on
four levels: a bit of level 0 is one day, a bit of level k is one full word of level k - 1. An interval of any length
becomes at most two words on each level (its ragged ends below, its full middle above), never one entry a day, so an
interval open for ten thousand years costs as little as one of a week. Words of one entity, level and place are united
by a bitwise OR, which combines before the shuffle; a hot entity is spread by (level, word), its time shard. Then the runs of
set bits come out of the words, are put together over their borders, and the runs of clear bits between are the gaps.

The calendar bounds what one entity can hold after the union: level 0 has at most 57,064 words, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import has_bit, shl, shr, ushr
from ..functions.dates import LAST_DAY, day_number

LEVELS = 4


def _bits(lo: Column, hi: Column) -> Column:
    """A word with the bits lo..hi (0..63) set."""
    ones = F.lit(-1).cast("bigint")
    return shl(ones, lo).bitwiseAND(ushr(ones, F.lit(63) - hi))


def cover_words(df: DataFrame, key: Sequence[str], first: str, last: str) -> DataFrame:
    """key, ``level``, ``word``, ``mask``: the united bitmap words of all intervals first..last (units from 0, inclusive)."""
    key = list(key)
    step = df.select(*key, F.col(first).cast("bigint").alias("_a"), F.col(last).cast("bigint").alias("_b"))
    pieces = []
    for level in range(LEVELS):
        a, b = F.col("_a"), F.col("_b")
        wa, wb = shr(a, 6), shr(b, 6)
        la, lb = a.bitwiseAND(F.lit(63)), b.bitwiseAND(F.lit(63))
        some, one, top = a <= b, wa == wb, level == LEVELS - 1
        word = lambda w, m: F.struct(F.lit(level).alias("level"), w.alias("word"), m.alias("mask"))  # noqa: E731,B023
        cut_a, cut_b = (la > 0) & ~one, (lb < 63) & ~one
        step = step.withColumns(
            {
                f"_p{2 * level}": F.when(some & one, word(wa, _bits(la, lb))).when(some & (F.lit(top) | cut_a), word(wa, _bits(la, F.lit(63)))),
                f"_p{2 * level + 1}": F.when(some & ~one & (F.lit(top) | cut_b), word(wb, _bits(F.lit(0), lb))),
                "_na": F.when(~some | one, F.lit(1)).otherwise(wa + cut_a.cast("bigint")),
                "_nb": F.when(~some | one, F.lit(0)).otherwise(wb - cut_b.cast("bigint")),
            }
        ).withColumns({"_a": F.col("_na"), "_b": F.col("_nb")})
        pieces += [f"_p{2 * level}", f"_p{2 * level + 1}"]
    words = step.select(*key, F.explode(F.filter(F.array(*pieces), lambda p: p.isNotNull())).alias("_w"))
    return words.groupBy(*key, F.col("_w.level").alias("level"), F.col("_w.word").alias("word")).agg(F.bit_or(F.col("_w.mask")).alias("mask"))


def set_runs(words: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, ``_from``, ``_to`` (units): the runs of set bits within each word."""
    m = F.col("mask")
    place = lambda x: F.when(x < 0, 63).otherwise(F.bit_count(x - 1)).cast("int")
    starts, ends = m.bitwiseAND(F.bitwise_not(shl(m, 1))), m.bitwiseAND(F.bitwise_not(ushr(m, 1)))
    places = F.sequence(F.lit(0), F.lit(63))
    many = F.arrays_zip(F.filter(places, lambda i: has_bit(starts, i)).alias("lo"), F.filter(places, lambda i: has_bit(ends, i)).alias("hi"))
    single = F.array(F.struct(place(starts).alias("lo"), place(ends).alias("hi")))
    runs = F.when(F.bit_count(starts) == 1, single).otherwise(many)
    size = shl(F.lit(1).cast("bigint"), F.col("level") * 6)
    got = words.select(*key, (F.col("word") * 64).alias("_w"), size.alias("_size"), F.explode(runs).alias("_r"))
    return got.select(*key, ((F.col("_w") + F.col("_r.lo")) * F.col("_size")).alias("_from"), ((F.col("_w") + F.col("_r.hi") + 1) * F.col("_size") - 1).alias("_to"))


def periods_and_gaps(df: DataFrame, key: Sequence[str], first: str, last: str) -> DataFrame:
    """key, ``kind`` (``period`` or ``gap``), ``from_unit``, ``to_unit`` (inclusive).

    Intervals are first..last, both inclusive, in units from 0; adjoining ones make one period. Rows with a null in key,
    first or last, or with first after last, take no part. An entity with one period has no gap; an empty table gives no rows.
    """
    key = list(key)
    good = df.dropna(subset=[*key, first, last]).filter(F.col(first) <= F.col(last))
    runs = set_runs(cover_words(good, key, first, last), key)
    w = Window.partitionBy(*key).orderBy("_from", "_to")
    reach = F.max("_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    heads = runs.select(*key, "_from", "_to", reach.alias("_reach"), F.max("_to").over(Window.partitionBy(*key)).alias("_end")).filter(F.col("_reach").isNull() | (F.col("_from") > F.col("_reach") + 1))
    piece = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("from_unit"), b.alias("to_unit"))
    heads = heads.withColumn("_until", F.coalesce(F.lead("_reach").over(w), F.col("_end")))
    period = piece("period", F.col("_from"), F.col("_until"))
    gap = F.when(F.col("_reach").isNotNull(), piece("gap", F.col("_reach") + 1, F.col("_from") - 1))
    return heads.select(*key, F.explode(F.array_compact(F.array(period, gap))).alias("_p")).select(*key, "_p.*")


def date_terms(df: DataFrame, start: str, end: str, point: str | None = None) -> DataFrame:
    """Adds ``_first`` and ``_last``, the day numbers of a term of which one end may be open; drops what is no term.

    A missing start is 0001-01-01, a missing end 9999-12-31. Rows with a point in time, with neither date or with start
    after end are no terms.
    """
    keep = F.col(start).isNotNull() | F.col(end).isNotNull()
    if point:
        keep &= F.col(point).isNull()
    terms = df.filter(keep).withColumns({"_first": F.coalesce(day_number(start), F.lit(0)), "_last": F.coalesce(day_number(end), F.lit(LAST_DAY))})
    return terms.filter(F.col("_first") <= F.col("_last"))
