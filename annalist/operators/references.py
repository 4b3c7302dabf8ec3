"""References to records that do not exist, by bitmaps over keys and periods.

The integer code of a key is the number in its id: a dictionary that is computed in both directions and needs no table (``encode_keys``
makes dense codes for keys that have no number). References and parents become bitmaps of one 64-bit word for each key and range of 64
periods, a word without a bit is not kept, and only periods that occur in the references have a place. Words are ORs that combine
before their exchange, so a key named by a tenth of all rows costs one row a task, and a parent that lives through all periods is one
word and no copy for each of them. Reference AND NOT parent leaves the orphans, whose bits are decoded to keys and periods again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import has_bit, shl

WORD = 64


def _ones(n: Column) -> Column:
    """The lowest n bits set, n from 0 to 64."""
    all_ = F.lit(-1).cast("bigint")
    return F.when(n >= WORD, all_).otherwise(F.bitwise_not(shl(all_, n)))


def _run(first: Column, end: Column, word: Column) -> Column:
    """The places first..end-1, as far as they lie in a word."""
    clip = lambda x: F.greatest(F.lit(0), F.least(F.lit(WORD), x - word * WORD))
    a, b = clip(first), clip(end)
    return F.when(b > a, shl(_ones(b - a), a)).otherwise(F.lit(0).cast("bigint"))


def reference_bitmaps(sources: Mapping[str, DataFrame], period: str, code: str, periods: Sequence[int]) -> DataFrame:
    """code, ``_word`` and for each source the word ``_in_<number>`` of the periods in which it names the key.

    Rows with a null code or a period that is not in ``periods`` drop out. All sources share one exchange, by key.
    """
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    place = F.array_position(F.lit(list(periods) or [0]).cast("array<bigint>"), F.col(period).cast("bigint")) - 1
    parts = [df.select(F.lit(i).alias("_tag"), F.col(code).alias("code"), place.alias("_place")) for i, df in enumerate(sources.values())]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    bit = shl(one, F.pmod(F.col("_place"), F.lit(WORD)))
    words = [F.bit_or(F.when(F.col("_tag") == i, bit).otherwise(zero)).alias(f"_in_{i}") for i in range(len(parts))]
    return rows.filter(F.col("code").isNotNull() & (F.col("_place") >= 0)).groupBy("code", F.floor(F.col("_place") / WORD).cast("int").alias("_word")).agg(*words)


def parent_bitmaps(df: DataFrame, code: str, start: str, end: str, periods: Sequence[int], instant: Callable[[Column], Column]) -> DataFrame:
    """code, ``_word``, ``_live``, ``_begun``: the words of the periods at whose instant a row of the parent is live or has begun.

    A row is live in a period if start <= instant(period) < end; a null end never comes, a null start was always there. It has begun
    if start <= instant(period). Periods are in order, so a row is a run of places. Every parent has its words, be they 0.
    """
    at = F.array(*(instant(F.lit(p)) for p in periods)) if periods else F.array(instant(F.lit(1)))
    before = lambda x: F.size(F.filter(at, lambda t: t < x))
    n = len(periods)
    first, last = F.when(F.col(start).isNull(), 0).otherwise(before(F.col(start))), F.when(F.col(end).isNull(), n).otherwise(before(F.col(end)))
    rows = df.filter(F.col(code).isNotNull()).select(F.col(code).alias("code"), first.alias("_first"), last.alias("_last"))
    rows = rows.withColumn("_word", F.lit(0) if n <= WORD else F.explode(F.sequence(F.lit(0), F.lit((n - 1) // WORD))))
    return rows.groupBy("code", "_word").agg(F.bit_or(_run(F.col("_first"), F.col("_last"), F.col("_word"))).alias("_live"), F.bit_or(_run(F.col("_first"), F.lit(n), F.col("_word"))).alias("_begun"))


def orphan_references(sources: Mapping[str, DataFrame], parents: DataFrame, period: str, code: str, periods: Sequence[int]) -> DataFrame:
    """``source``, ``period``, ``code``, ``kind`` of the references of all sources without a live parent.

    kind: ``missing`` (no parent row has the key), ``later`` (all its rows begin after the instant), else ``deleted``. References
    into an empty parent table are all missing; empty reference tables give no rows.
    """
    refs = reference_bitmaps(sources, period, code, periods)
    met = refs.join(parents.withColumnRenamed("code", "_code").withColumnRenamed("_word", "_at"), (F.col("code") == F.col("_code")) & (F.col("_word") == F.col("_at")), "left")
    live = F.bitwise_not(F.coalesce("_live", F.lit(0).cast("bigint")))
    orphans = [F.struct(F.lit(name).alias("source"), F.col(f"_in_{i}").bitwiseAND(live).alias("bits")) for i, name in enumerate(sources)]
    left = met.select("code", "_word", "_begun", F.explode(F.array(*orphans)).alias("_o")).filter(F.col("_o.bits") != 0)
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: has_bit(F.col("_o.bits"), i))
    found = left.select("_o.source", "code", "_word", "_begun", F.explode(places).alias("_i"))
    kind = F.when(F.col("_begun").isNull(), "missing").when(~has_bit(F.col("_begun"), F.col("_i")), "later").otherwise("deleted")
    named = F.get(F.lit(list(periods) or [0]).cast("array<bigint>"), F.col("_word") * WORD + F.col("_i")).cast("int")
    return found.select("source", named.alias("period"), "code", kind.alias("kind"))


def encode_keys(df: DataFrame, column: str) -> DataFrame:
    """``column`` and ``code``: a dense dictionary of any keys, for keys that are not numbers by themselves.

    The distinct keys are ordered by range partitions and numbered within them; only the partitions' sizes (one row each)
    pass through one task. Nulls are no keys.
    """
    from pyspark.sql import Window

    keys = df.select(column).dropna().distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id())
    n = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keys.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(n), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return keys.withColumn("_n", within).join(F.broadcast(offsets), "_part").select(column, (F.col("_n") + F.col("_offset")).cast("bigint").alias("code"))
