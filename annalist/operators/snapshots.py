"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import has_bit, shl, shr

#: Snapshots that one word holds beside the last one of the word before.
WORD = 63


def snapshot_list(df: DataFrame, snapshot: str) -> list[int]:
    """All snapshots of a table in order: one number a delivery, read from that column alone. Nulls are no snapshot."""
    found = df.select(F.col(snapshot).cast("bigint").alias("s")).filter("s IS NOT NULL").groupBy("s").count().agg(F.array_sort(F.collect_list("s")).alias("all")).first()
    return list(found["all"] or [])


def row_hash(content: Sequence[Column], types: Sequence[T.DataType]) -> Column:
    """Canonical 64-bit hash of a row: each column with its null flag and, of a list, its size, so that nothing slides from one column into the next."""
    return F.xxhash64(*(x for c, t in zip(content, types, strict=True) for x in (c.isNull(), *([F.size(c)] if isinstance(t, T.ArrayType) else []), c)))


def snapshot_changes(df: DataFrame, key: Sequence[str], snapshot: str, content: Sequence[Column], snapshots: Sequence[int] | None = None) -> DataFrame:
    """Key, snapshot (the later of two) and ``change``: ``added``, ``removed`` or ``changed``.

    ``content`` are the columns whose distinct combinations make a record's state; a key may have several rows in a
    snapshot, their order and repetition mean nothing. Each snapshot is compared with the one before it in ``snapshots``, the list of
    all there are in order (None: those in the table), so years without a delivery are no gap. The first snapshot has no rows. Rows
    with a null in key or snapshot take no part; an empty table gives no rows. Columns beyond those named are ignored.

    The full outer join of a snapshot with the one before, on key and canonical row hash, is done for 63 pairs of snapshots at a
    time: of each (key, row hash) a 64-bit word tells the snapshots that hold it, and the word with itself moved on by one snapshot
    are the two sides. Bits on one side only are unequal hashes; a key none of whose hashes is on a side is missing there. A word
    begins with the last snapshot of the word before. Both steps, by (key, row hash) and by key, are ORs of words that combine before
    their exchange: repeats and unchanged rows vanish in the first, and no set of a key's rows is ever gathered.
    """
    key = list(key)
    all_ = snapshot_list(df, snapshot) if snapshots is None else list(snapshots)
    types = [f.dataType for f in df.select(*content).schema.fields]
    place = F.array_position(F.lit(all_ or [0]).cast("array<bigint>"), F.col(snapshot).cast("bigint")) - 1
    rows = df.filter(F.col(snapshot).isNotNull()).dropna(subset=key).select(*key, place.cast("int").alias("_o"), row_hash(content, types).alias("_h")).filter("_o >= 0")
    one = F.lit(1).cast("bigint")
    if len(all_) <= WORD + 1:
        rows = rows.withColumn("_w", F.lit(0))
    else:  # the last snapshot of a word is in the next one too
        words = F.when((F.col("_o") % WORD == 0) & (F.col("_o") > 0), F.array((F.col("_o") / WORD).cast("int") - 1, (F.col("_o") / WORD).cast("int"))).otherwise(F.array((F.col("_o") / WORD).cast("int")))
        rows = rows.withColumn("_w", F.explode(words))
    held = rows.groupBy(*key, "_w", "_h").agg(F.bit_or(shl(one, F.col("_o") - F.col("_w") * WORD)).alias("_in"))
    before = shl(F.col("_in"), F.lit(1))
    joined = held.groupBy(*key, "_w").agg(F.bit_or("_in").alias("_now"), F.bit_or(F.col("_in").bitwiseXOR(before)).alias("_unequal"))
    was = shl(F.col("_now"), F.lit(1))
    met = joined.select(*key, "_w", "_now", was.alias("_was"), F.col("_unequal").bitwiseAND(F.col("_now").bitwiseOR(was)).alias("_differ")).filter(shr(F.col("_differ"), F.lit(1)) != 0)
    places = F.filter(F.sequence(F.lit(1), F.lit(WORD)), lambda i: has_bit(F.col("_differ"), i))
    out = met.select(*key, "_w", "_now", "_was", F.explode(places).alias("_i")).withColumn("_o", F.col("_w") * WORD + F.col("_i")).filter(F.col("_o") < len(all_))
    change = F.when(~has_bit(F.col("_was"), F.col("_i")), "added").when(~has_bit(F.col("_now"), F.col("_i")), "removed").otherwise("changed")
    return out.select(F.get(F.lit(all_ or [0]).cast("array<bigint>"), F.col("_o")).cast(df.schema[snapshot].dataType).alias(snapshot), *key, change.alias("change"))
