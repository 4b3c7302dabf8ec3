"""Joins of facts: complements, hops, present day, consecutive anchors, pairs within a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded
from ..schemas import COMPLEMENTS, THREE_HOPS, TWO_HOPS
from .sampling import seeded_ranks


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def complement_of(pid: Column | str, pairs: dict[str, str] = COMPLEMENTS) -> Column:
    """Property that completes ``pid``, null if none does; a constant map, so no join."""
    table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return F.try_element_at(table, F.col(pid) if isinstance(pid, str) else pid)


def one_each(df: DataFrame, keys: Sequence[str], seed: str | int = 42) -> DataFrame:
    """One row for each key, the first in seeded order of its value, so that entities of one label stand for one."""
    w = Window.partitionBy(*keys).orderBy(seeded(seed, F.col("value_qid")), "value_qid", "value_label", "subject_qid")
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def complement_join(df: DataFrame, keys: Sequence[str], pairs: dict[str, str] = COMPLEMENTS, seed: str | int = 42) -> DataFrame:
    """For each key and property one row with one of the completing property; the columns of the latter begin with ``b_``."""
    one = one_each(df, [*keys, "pid"], seed)
    left = one.withColumn("_other", complement_of("pid", pairs)).filter(F.col("_other").isNotNull())
    return left.join(prefixed(one, "b_"), [F.col("_other") == F.col("b_pid"), *(F.col(k) == F.col(f"b_{k}") for k in keys)]).drop("_other")


def hop_join(df: DataFrame, within: Sequence[str], rules: Sequence[tuple[str, str]] = TWO_HOPS, order: Sequence[str] = ("value_label",), left: str = "", identity: Sequence[str] | None = None) -> DataFrame:
    """First continuation of each row: its value is the subject of the next under an allowed pair of properties.

    "First" is the smallest (pid, ``order``) of the next rows. The right side is reduced to its first row for each (subject, property)
    before the join, so that a subject with very many rows meets each left row once. Columns of the next row begin with ``n_``.
    """
    allowed = F.create_map(*(x for p in dict.fromkeys(a for a, _ in rules) for x in (F.lit(p), F.array(*(F.lit(b) for a, b in rules if a == p)))))
    w = Window.partitionBy(*within, "subject_label", "pid").orderBy(*order, *[c for c in df.columns if c not in order])
    firsts = prefixed(df.filter(F.col("pid").isin([b for _, b in rules])).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn"), "n_")
    start = df if not left else df
    met = start.withColumn("_next", F.explode(F.try_element_at(allowed, F.col("pid")))).join(firsts, [F.col("value_label") == F.col("n_subject_label"), F.col("_next") == F.col("n_pid"), *(F.col(c) == F.col(f"n_{c}") for c in within)])
    return best_continuation(met.drop("_next"), list(identity or df.columns))


def best_continuation(met: DataFrame, identity: list[str]) -> DataFrame:
    w = Window.partitionBy(*identity).orderBy("n_pid")
    return met.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def three_hop_join(df: DataFrame, within: Sequence[str], pids: Sequence[str] = THREE_HOPS, order: Sequence[str] = ("value_label",)) -> DataFrame:
    """Rows of the first property with their first second hop (``n_``) and its first third hop (``t_``)."""
    a, b, c = pids
    two = hop_join(df.filter(F.col("pid").isin(a, b)), within, [(a, b)], order)
    w = Window.partitionBy(*within, "subject_label").orderBy(*order, *[x for x in df.columns if x not in order])
    last = prefixed(df.filter(F.col("pid") == c).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn"), "t_")
    return two.join(last, [F.col("n_value_label") == F.col("t_subject_label"), *(F.col(x) == F.col(f"t_{x}") for x in within)])


def annotate_present(df: DataFrame, present: DataFrame, answer: str = "answer", subject: str = "subject_label", pid: str = "pid") -> DataFrame:
    """Adds present_day_answer, present_day_value_qid and drift_eligible from the present rows of the same subject label and property.

    Of several present rows the one with the smallest (value_label, value_qid) counts; without one the flag is false.
    """
    side = present.groupBy(F.col("subject_label").alias("_s"), F.col("pid").alias("_p")).agg(F.min(F.struct("value_label", "value_qid")).alias("_v"))
    met = df.join(side, (F.col(subject) == F.col("_s")) & (F.col(pid) == F.col("_p")), "left")
    shown = {"present_day_answer": F.col("_v.value_label"), "present_day_value_qid": F.col("_v.value_qid"), "drift_eligible": F.coalesce(F.col("_v.value_label") != F.col(answer), F.lit(False))}
    return met.withColumns(shown).drop("_s", "_p", "_v")


def next_anchors(df: DataFrame) -> DataFrame:
    """anchor_date and next_anchor of consecutive anchors of a snapshot year; as many rows as there are anchors."""
    days = df.select("snapshot_year", "anchor_date").distinct()
    w = Window.partitionBy("snapshot_year").orderBy("anchor_date")
    return days.withColumn("next_anchor", F.lead("anchor_date").over(w)).filter(F.col("next_anchor").isNotNull())


def consecutive_anchors(df: DataFrame, keys: Sequence[str], least: int = 2, seed: str | int = 42) -> DataFrame:
    """For each key and property a row at an anchor with one at the next anchor of the same snapshot year (``b_``), for keys with ``least`` such properties."""
    one = one_each(df, ["snapshot_year", "anchor_date", *keys, "pid"], seed)
    same = [F.col(c) == F.col(f"b_{c}") for c in ("snapshot_year", "pid", *keys)]
    met = one.join(F.broadcast(next_anchors(df)), ["snapshot_year", "anchor_date"]).join(prefixed(one, "b_"), [F.col("next_anchor") == F.col("b_anchor_date"), *same])
    enough = met.groupBy(*keys, "anchor_date").agg(F.count_distinct("pid").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return met.join(enough, [*keys, "anchor_date"], "left_semi")


def pair_neighbours(df: DataFrame, group: Sequence[str], item: str, seed: str | int = 42, cap: int | None = 2000) -> DataFrame:
    """Items of a group paired without replacement in a seeded order: group, pair_no, a, b.

    ``cap`` is the feature's own limit: only the first ``cap`` + 1 items in that order are paired (None: all). Ranks are taken by
    buckets of the order, so that no task sorts a large group (see ``seeded_ranks``).
    """
    items = df.select(*group, item).distinct()
    ranked = seeded_ranks(items, group, seeded(seed, *(F.col(g) for g in group), F.col(item)), [item], 2 * ((cap + 1) // 2) if cap else None)
    no = F.floor((F.col("_rn") - 1) / 2).cast("bigint")
    halves = ranked.groupBy(*group, no.alias("pair_no")).agg(F.min(F.struct("_rn", F.col(item).alias("v"))).alias("_a"), F.max(F.struct("_rn", F.col(item).alias("v"))).alias("_b"))
    return halves.filter(F.col("_a._rn") < F.col("_b._rn")).select(*group, "pair_no", F.col("_a.v").alias("a"), F.col("_b.v").alias("b"))
