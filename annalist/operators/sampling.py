"""Caps, samples and shuffles that give the same rows on every run and every partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded


def cap_rows(df: DataFrame, n: int | None, seed: str | int, key: Sequence[str]) -> DataFrame:
    """Exactly ``n`` rows in seeded order (all if there are fewer); None, 0 and negative numbers mean no cap."""
    if not n or n < 0:
        return df
    return df.orderBy(seeded(seed, *(F.col(k) for k in key)), *key).limit(n)


#: Rows of a group from which its seeded order is ranked by buckets.
LARGE = 100_000


def seeded_ranks(df: DataFrame, group: Sequence[str], order: Column, key: Sequence[str], most: int | None = None, large: int = LARGE) -> DataFrame:
    """``df`` with ``_rn``, the rank of a row in its group by ``order`` (hex digits of a hash), then ``key``; ranks up to ``most`` only (None: all).

    A group of more than ``large`` rows falls into 65,536 buckets by the first four digits. Rows are ranked within their bucket, beginning
    after the number of rows in earlier ones, and buckets that begin beyond ``most`` are left out before, so that no task ever sorts a whole group.
    """
    rows = df.withColumn("_h", order)
    named = lambda d: d.select(*(F.col(g).alias(f"_g_{i}") for i, g in enumerate(group)), *(c for c in d.columns if c not in group))
    same = lambda *more: [*(F.col(g).eqNullSafe(F.col(f"_g_{i}")) for i, g in enumerate(group)), *more]
    drop = [f"_g_{i}" for i in range(len(group))]
    sizes = named(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > large))
    bucket = F.when(F.col("_size").isNotNull(), F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")).otherwise(-1)
    rows = rows.join(sizes, same(), "left").withColumn("_bucket", bucket).drop(*drop, "_size")
    filled = rows.filter("_bucket >= 0").groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_bucket")) - F.col("_n")
    begins = named(filled.select(*group, F.col("_bucket").alias("_b"), before.alias("_before")))
    rows = rows.join(begins, same(F.col("_bucket") == F.col("_b")), "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
    if most:
        rows = rows.filter(F.col("_before") < most)
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy("_h", *key)) + F.col("_before"))
    return (ranked.filter(F.col("_rn") <= most) if most else ranked).drop(*drop, "_b", "_before", "_bucket", "_h")


def cap_groups(df: DataFrame, group: Sequence[str], n: int | None, seed: str | int, key: Sequence[str]) -> DataFrame:
    """At most ``n`` rows of each group in seeded order, ranked by buckets of it (see ``seeded_ranks``)."""
    if not n or n < 0:
        return df
    return seeded_ranks(df, group, seeded(seed, *(F.col(k) for k in key)), key, n).drop("_rn")


def stratified_sample(df: DataFrame, strata: Sequence[str], n: int, seed: str | int, key: str) -> DataFrame:
    """``n`` rows with ``sample_rank``: max(1, n div strata) of each stratum, topped up from the rest, cut at n; in order of strata, then the rest.

    The ranks within strata and over the rest are row_number filters below n, which Spark applies before the shuffle.
    """
    order = seeded(seed, F.col(key))
    strata_n = max(1, df.select(*strata).distinct().count())
    each = max(1, n // strata_n)
    ranked = df.withColumn("_h", order).withColumn("_rn", F.row_number().over(Window.partitionBy(*strata).orderBy("_h", key)))
    quota = ranked.filter(F.col("_rn") <= each).withColumn("_phase", F.lit(0))
    rest = ranked.filter(F.col("_rn") > each).orderBy("_h", key).limit(n).withColumn("_phase", F.lit(1))
    both = quota.unionByName(rest).orderBy("_phase", *(F.when(F.col("_phase") == 0, F.col(s)) for s in strata), "_h", key).limit(n)
    w = Window.orderBy("_phase", *(F.when(F.col("_phase") == 0, F.col(s)) for s in strata), "_h", key)
    return both.withColumn("sample_rank", F.row_number().over(w)).drop("_h", "_rn", "_phase")
