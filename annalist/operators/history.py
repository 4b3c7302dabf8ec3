"""Versions of entity attributes over time: a type-two dimension, merged from full snapshots.

The dimension holds, for each key, the versions of its attributes with the first and last snapshot of each. Merging a snapshot
compares the hash of a key's attributes with that of the key's current version, the one still open at the snapshot before:
an equal hash extends it, an unequal one closes it at the snapshot before and inserts a new open version, a key that the snapshot lacks
has its version closed, a new key gets an open one. ``merge_snapshots`` does that for one snapshot or many, in their order,
into a dimension or into none: versions and states of a key meet in one exchange and are merged there, key by key. Each state meets the
version that is current before it; where it does not continue it, that version is closed with its last snapshot and a new one is inserted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .snapshots import snapshot_list


def attribute_hash(attributes: Sequence[str]) -> Column:
    """64-bit hash of the attributes, each with its null flag, so that null differs from every value. Without attributes presence alone counts."""
    return F.xxhash64(F.lit(True), *(x for a in attributes for x in (F.col(a).isNull(), F.col(a))))


def merge_snapshots(rows: DataFrame, key: Sequence[str], snapshot: str, attributes: Sequence[str] | Mapping[str, Column], snapshots: Sequence[int], versions: DataFrame | None = None) -> DataFrame:
    """The dimension after all snapshots in ``rows``: key, attributes, ``valid_from``, ``valid_to`` (snapshots, both inclusive).

    ``versions`` is the dimension before them, in the same form (None: there is none). ``snapshots`` are all snapshots there
    are, old and new, in order: a version whose ``valid_to`` is the last but one is still open for the last. Several rows of a key in
    one snapshot make one state: ``attributes`` may give an aggregate for each name, else the greatest ``(hash, attributes)`` stands
    for it. Rows with a null in key or snapshot take no part. Other columns are ignored. An empty table gives the dimension as it was.

    Repeats combine to a state a key and snapshot before the first exchange, so a key with a third of all rows costs one row a
    task and snapshot. What meets in one row is a key's states and versions, at most as many as there are snapshots.
    """
    key, made = list(key), attributes if isinstance(attributes, Mapping) else None
    attributes = list(attributes)
    places = F.lit(list(snapshots) or [0]).cast("array<bigint>")
    place = lambda c: F.array_position(places, F.col(c).cast("bigint")).cast("int")
    given = rows.filter(F.col(snapshot).isNotNull()).dropna(subset=key).groupBy(*key, F.col(snapshot).alias("_at"))
    if made:
        states = given.agg(*(c.alias(a) for a, c in made.items()))
    else:
        states = given.agg(F.max(F.struct(attribute_hash(attributes).alias("_h"), *(F.col(a) for a in attributes))).alias("_s")).select(*key, "_at", *(F.col(f"_s.{a}").alias(a) for a in attributes))
    met = states.select(*key, *attributes, place("_at").alias("_first"), place("_at").alias("_last"))
    if versions is not None:
        met = met.unionByName(versions.select(*key, *attributes, place("valid_from").alias("_first"), place("valid_to").alias("_last")))
    step = F.struct(F.col("_first").alias("first"), F.col("_last").alias("last"), attribute_hash(attributes).alias("h"), *(F.col(a) for a in attributes))
    inputs = met.repartition(*(F.col(k) for k in key)).groupBy(*key).agg(F.array_sort(F.collect_list(step)).alias("_v"))

    def changed(current: Column, new: Column) -> Column:
        """Whether a state is no continuation of the version that is current before it: a gap between them or unequal hashes."""
        return (current["last"] != new["first"] - 1) | (current["h"] != new["h"])

    v = F.col("_v")
    inserted = F.filter(v, lambda x, i: (i == 0) | changed(F.get(v, i - 1), x))
    closed = F.filter(v, lambda x, i: (i == F.size(v) - 1) | changed(x, F.get(v, i + 1)))
    merged = inputs.select(*key, F.zip_with(inserted, closed, lambda new, end: new.withField("last", end["last"])).alias("_v"))
    out = merged.select(*key, F.explode("_v").alias("_v"))
    named = lambda c: F.element_at(places, F.col(f"_v.{c}")).cast(rows.schema[snapshot].dataType)
    return out.select(*key, *(F.col(f"_v.{a}").alias(a) for a in attributes), named("first").alias("valid_from"), named("last").alias("valid_to"))


def build_history(rows: DataFrame, key: Sequence[str], snapshot: str, attributes: Sequence[str] | Mapping[str, Column] = ()) -> DataFrame:
    """All versions from all snapshots of ``rows``, merged in order into an empty dimension (see ``merge_snapshots``)."""
    return merge_snapshots(rows, key, snapshot, attributes, snapshot_list(rows, snapshot))
