"""Mixing sources to target shares of a total counted in tokens, by subset-sum budget fitting.

The budget of each source follows from the shares and from what the scarcest source can give with its repeats. Whole passes over
a source come first; the rest of its budget is fitted: documents are counted by exact token length, counts are taken in
proportion to the lengths there are, then a bounded-knapsack dynamic programme over lengths rearranges a window at the end of the budget
to close the remaining gap. The window holds at least two of the longest documents and doubles, up to the whole budget, until the gap is closed, so
that what remains of it could not be closed by any choice of documents. Which documents of a length are used is decided by a seeded order.

Only counts by (source, length) reach the programme, one source to a task; their number is that of distinct lengths. Documents of a
length are ranked in buckets of the seeded order, so that a length shared by a third of all documents is never sorted in one task.
"""

from __future__ import annotations

from math import gcd

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

#: Least number of tokens that the dynamic programme rearranges at first, and buckets of the seeded order.
WINDOW, BUCKETS = 8192, 1024


def reach(budget: int, lengths: list[tuple[int, int]]) -> dict[int, int]:
    """Number of documents of each length whose sum comes closest to the budget from below; bounded knapsack over bit sets."""
    parts, sets, full = [], [1], (1 << (budget + 1)) - 1
    for length, count in lengths:
        if not 0 < length <= budget:
            continue
        left, k = min(count, budget // length), 1
        while left > 0:
            take = min(k, left)
            parts.append((length, take))
            sets.append((sets[-1] | sets[-1] << (length * take)) & full)
            left, k = left - take, k * 2
    at, used = sets[-1].bit_length() - 1, {}
    for i in range(len(parts) - 1, -1, -1):
        if not sets[i] >> at & 1:
            length, take = parts[i]
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def fit(budget: int, counts: dict[int, int], window: int = WINDOW) -> dict[int, int]:
    """Number of documents of each length, at most ``counts``, whose tokens sum to the budget or as little below it as can be.

    Lengths and budget are divided by the lengths' greatest common divisor, so a budget that no sum can meet is lowered to one
    that could be. ``window`` is the first size of what is rearranged; it doubles until the sum is the budget or all of it was rearranged.
    """
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return dict(counts)
    if budget <= 0:
        return {}
    unit = gcd(*counts)
    counts, budget, total = {n // unit: c for n, c in counts.items()}, budget // unit, total // unit
    window = max(window, 2 * max(counts))
    while True:
        took = {n: c * budget // total for n, c in counts.items()}
        left = budget - sum(n * k for n, k in took.items())
        for n in sorted(counts, reverse=True):
            more = min(counts[n] - took[n], left // n)
            took[n] += more
            left -= n * more
        if left:
            for n in sorted(counts):
                back = took[n] if window >= budget else min(took[n], max(0, (window - left) // n))
                took[n] -= back
                left += n * back
            for n, k in reach(left, sorted((n, counts[n] - took[n]) for n in counts)).items():
                took[n] += k
                left -= n * k
        if not left or window >= budget:
            return {n * unit: k for n, k in took.items() if k}
        window *= 2


_PLAN = "mix_name string, source string, n_tokens bigint, passes bigint, extra bigint"


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    counts = dict(zip(rows["n_tokens"].astype(int), rows["n_docs"].astype(int), strict=True))
    budget, repeats = int(rows["budget"].iloc[0]), int(rows["max_repeats"].iloc[0])
    total = sum(n * c for n, c in counts.items())
    passes = min(repeats, budget // total) if total else 0
    extra = fit(budget - passes * total, counts) if passes < repeats else {}
    out = pd.DataFrame({"n_tokens": list(counts)})
    return out.assign(mix_name=rows["mix_name"].iloc[0], source=rows["source"].iloc[0], passes=[passes if n else 0 for n in counts], extra=[extra.get(n, 0) for n in counts])[["mix_name", "source", "n_tokens", "passes", "extra"]]


def source_name(col: str):
    """Source as one key however written: lower case without blanks around; empty becomes null."""
    return F.nullif(F.lower(F.trim(F.col(col), F.lit(" \t\r\n "))), F.lit(""))


def budgets(targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """mix_name, source, share, max_repeats, n_docs, available, budget of each target, ``available`` and ``budget`` in tokens.

    The total of a mix is the greatest for which no source needs more than ``available`` times ``max_repeats``. Sources without
    tokens can give nothing: their budget is 0 and the others keep their relative weights.
    """
    asked = targets.select("mix_name", source_name("source").alias("source"), "weight", "max_repeats").filter((F.col("weight") > 0) & (F.col("max_repeats") >= 1))
    asked = asked.groupBy("mix_name", "source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    met = asked.join(sizes, "source", "left").fillna(0, ["n_docs", "available"])
    w = Window.partitionBy("mix_name")
    able = F.when(F.col("available") > 0, F.col("weight"))
    met = met.withColumns({"share": F.col("weight") / F.sum("weight").over(w), "_able": able / F.sum(able).over(w)})
    total = F.min(F.col("available") * F.col("max_repeats") / F.col("_able")).over(w)
    return met.withColumn("_total", total).select("mix_name", "source", "share", "max_repeats", "n_docs", "available", F.coalesce(F.floor(F.col("_total") * F.col("_able") + F.lit(1e-6)), F.lit(0)).cast("bigint").alias("budget"))


def mix(documents: DataFrame, targets: DataFrame, key: str, seed: str = "mix") -> DataFrame:
    """mix_name, source, key, n_tokens, ``repeats`` of each document used.

    ``documents`` has key, ``source`` and ``n_tokens``. Documents without source or tokens are never used. Targets with a null or
    non-positive weight or with fewer than one repeat ask for nothing; repeated targets of a mix and source add up. Equal seeds give
    equal choices, whatever the partitioning. Empty tables give no rows.
    """
    docs = documents.select(key, source_name("source").alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens")).filter(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    hist = docs.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    sizes = hist.groupBy("source").agg(F.sum("n_docs").alias("n_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("available"))
    wanted = budgets(targets, sizes).select("mix_name", "source", "max_repeats", "budget").filter(F.col("budget") > 0)
    plan = checkpoint(hist.join(wanted, "source").groupBy("mix_name", "source").applyInPandas(_plan, _PLAN).filter((F.col("passes") > 0) | (F.col("extra") > 0)))
    order = F.xxhash64(F.lit(seed), F.col("mix_name"), F.col(key))
    met = docs.join(plan, ["source", "n_tokens"]).withColumns({"_h": order, "_b": F.pmod(F.shiftright(order, 32), F.lit(BUCKETS))})
    cell = ["mix_name", "source", "n_tokens"]
    filled = met.filter("extra > 0").groupBy(*cell, "_b").agg(F.count(F.lit(1)).alias("_c"), F.first("extra").alias("_extra"))
    so_far = F.sum("_c").over(Window.partitionBy(*cell).orderBy("_b"))
    places = filled.select(*cell, "_b", "_c", (F.col("_extra") - so_far + F.col("_c")).alias("_room"))
    near = met.join(places, [*cell, "_b"], "left").withColumn("_cut", (F.col("_room") > 0) & (F.col("_room") < F.col("_c")))
    whole = near.filter(~F.coalesce("_cut", F.lit(False))).withColumn("_more", F.coalesce((F.col("_room") > 0).cast("int"), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*cell, "_b").orderBy("_h", key))
    split = near.filter("_cut").withColumn("_more", (rank <= F.col("_room")).cast("int"))
    used = whole.unionByName(split).withColumn("repeats", F.col("passes") + F.col("_more")).filter("repeats > 0")
    return used.select("mix_name", "source", key, "n_tokens", "repeats")


def mix_report(used: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, target_share, real_share, n_docs, available_tokens, used_docs, used_tokens, most_repeats of each target,
    and ``gap_tokens``, what its budget has beyond them."""
    docs = documents.select(source_name("source").alias("source"), "n_tokens").filter(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("available"))
    got = used.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("used_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    met = budgets(targets, sizes).join(got, ["mix_name", "source"], "left").fillna(0, ["used_docs", "used_tokens", "most_repeats"])
    real = F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(Window.partitionBy("mix_name"))), F.lit(0.0))
    return met.select("mix_name", "source", F.round("share", 6).alias("target_share"), F.round(real, 6).alias("real_share"), "n_docs", F.col("available").alias("available_tokens"), "used_docs", "used_tokens", "most_repeats", (F.col("budget") - F.col("used_tokens")).alias("gap_tokens"))
