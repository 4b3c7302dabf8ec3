"""What held at an anchor date: as-of validity, rank preference and the best row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import first_day, last_day
from ..schemas import TRUTH_QUALIFIERS

MONTH_DAYS = ("01-01", "04-01", "07-01", "10-01")


def valid_at(anchor: Column, start: Column, end: Column, point: Column) -> Column:
    """A point in time holds in its whole year; otherwise the closed interval with open ends counts."""
    between = (start.isNull() | (start <= anchor)) & (end.isNull() | (end >= anchor))
    return F.when(point.isNotNull(), F.year(point) == F.year(anchor)).otherwise(between)


def rank_score(rank: Column | str) -> Column:
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.when(r == "preferred", 2).when(r == "normal", 1).otherwise(0)


def with_days(claims: DataFrame) -> DataFrame:
    """start_date (earliest), end_date (latest) and pit_date (earliest) from the time lists."""
    return claims.withColumns({"start_date": first_day("q_start_time"), "end_date": last_day("q_end_time"), "pit_date": first_day("q_point_in_time")})


def with_anchors(df: DataFrame, month_days: Sequence[str] = MONTH_DAYS, year: str = "snapshot_year") -> DataFrame:
    """Each row once for each anchor of its snapshot year, as ``anchor_date``; no join, so nothing is shuffled."""
    days = F.array(*(F.make_date(F.col(year), F.lit(int(d[:2])), F.lit(int(d[3:]))) for d in month_days))
    return df.withColumn("anchor_date", F.explode(days))


def best_rows(df: DataFrame, key: Sequence[str], score: str = "rank_score", order: Sequence[str] = ()) -> DataFrame:
    """The row of highest score for each key; ties go to the smallest value, start, end, point, then the columns of ``order``."""
    ties = [c for c in ("value_qid", "start_date", "end_date", "pit_date") if c in df.columns]
    w = Window.partitionBy(*key).orderBy(F.col(score).desc(), *ties, *order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def build_truth(claims: DataFrame, month_days: Sequence[str] = MONTH_DAYS) -> DataFrame:
    """All rows that hold at the anchors of their snapshot year, with ``truth_type`` temporal or timeless; the grain is all_active.

    ``claims`` has the claim keys and start_date, end_date, pit_date (``with_days``); the qualifier lists that are there are kept. Deprecated
    statements and those of a subject about itself drop out, as do rows with a null rank, subject or value. Statements without any
    date are timeless and hold at every anchor. ``best_rows(truth, ["anchor_date", "truth_type", "subject_qid", "pid"])`` gives the best grain.
    """
    kept = claims.filter((F.col("rank") != "deprecated") & (F.col("subject_qid") != F.col("value_qid"))).withColumn("rank_score", rank_score("rank"))
    dated = F.coalesce("start_date", "end_date", "pit_date").isNotNull()
    rows = with_anchors(kept.withColumn("truth_type", F.when(dated, "temporal").otherwise("timeless")), month_days)
    held = rows.filter((F.col("truth_type") == "timeless") | valid_at(F.col("anchor_date"), F.col("start_date"), F.col("end_date"), F.col("pit_date")))
    extra = [c for c in TRUTH_QUALIFIERS if c in claims.columns]
    return held.select("snapshot_year", "anchor_date", "truth_type", "subject_qid", "pid", "value_qid", "rank", "rank_score", "start_date", "end_date", "pit_date", *extra)


def best_truth(truth: DataFrame) -> DataFrame:
    return best_rows(truth, ["anchor_date", "truth_type", "subject_qid", "pid"])


def latest_anchor(truth: DataFrame, truth_type: str | None = None, day: str | None = None) -> DataFrame:
    """Rows of the given or the last anchor date."""
    rows = truth.filter(F.col("truth_type") == truth_type) if truth_type else truth
    if day:
        return rows.filter(F.col("anchor_date") == F.to_date(F.lit(day)))
    last = rows.agg(F.max("anchor_date").alias("d")).first()["d"]
    return rows.filter(F.col("anchor_date") == F.lit(last))
