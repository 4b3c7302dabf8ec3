"""Queries of the text problems (p6, p8 to p10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import item_id, item_number, property_id, property_number, rank_name, sql_item, sql_property
from ..session import checkpoint, table
from . import consensus, mixing, sentences, tokenizer


# 6. Best representative of each duplicate group

_GROUP = ["a", "s", "p"]


def _trusted(spark: SparkSession, folder: str) -> DataFrame:
    rank = rank_name("rank", None)
    named = F.when(rank == "preferred", 2).when(rank == "deprecated", 0).when(rank.isNotNull(), 1)
    trust = F.coalesce(named, F.when(F.col("rank_score").isNotNull(), F.least(F.greatest("rank_score", F.lit(0)), F.lit(2))), F.lit(1))
    present = sum(F.col(c).isNotNull().cast("int") for c in ("start_date", "end_date", "pit_date"))
    rows = table(spark, folder, "temporal_facts").select(
        F.col("anchor_date").alias("a"), item_number("subject_qid").alias("s"), property_number("pid").cast("int").alias("p"), item_number("value_qid").alias("v"), trust.alias("trust"), present.alias("present"), "built_at", "start_date", "end_date"
    )
    built = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '0001-01-01 00:00:00', built_at)")
    order = (F.col("trust") * 4 + F.col("present")).cast("bigint") * F.lit(1 << 57) + F.coalesce(built, F.lit(0))
    return rows.dropna(subset=_GROUP).withColumn("w", order)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Survivors by consensus of whole rows (value, trust, dates) whose votes follow the order of the rows.

    Value and rank are those of the surviving row, the dates those of the consensus of the rows with its value.
    """
    number = F.lpad(F.col("v").cast("string"), 18, "0")  # of one length, so that the smallest text is the smallest number
    record = F.array(F.coalesce(number, F.lit("")), F.col("trust").cast("string"), F.col("start_date").cast("string"), F.col("end_date").cast("string"))
    kept = consensus.consensus(_trusted(spark, folder).withColumn("record", record), _GROUP, "record", "w", dominant=True).filter("n_rows > 1")
    value = F.col("value")[0]
    names = F.create_map(F.lit("2"), F.lit("preferred"), F.lit("1"), F.lit("normal"), F.lit("0"), F.lit("deprecated"))
    text = lambda i: F.coalesce(F.col("consensus")[i], F.lit(""))
    item = F.when(value == "", "").otherwise(item_id(value.cast("bigint")))
    return kept.select(F.col("a").cast("string").alias("anchor_date"), item_id("s").alias("subject_qid"), property_id("p").alias("pid"), item.alias("value_qid"), names[F.col("value")[1]].alias("rank"), text(2).alias("start_date"), text(3).alias("end_date"))


P6_FOUND_SQL = f"""
WITH t AS (SELECT anchor_date AS a, {sql_item('subject_qid')} AS s, {sql_property('pid')} AS p, {sql_item('value_qid')} AS v, start_date, end_date, built_at,
  CASE lower(trim(rank, ' ' || chr(9) || chr(10) || chr(13))) WHEN 'preferred' THEN 2 WHEN 'normal' THEN 1 WHEN 'deprecated' THEN 0 ELSE COALESCE(rank_score, 1) END AS trust,
  (start_date IS NOT NULL)::INT + (end_date IS NOT NULL)::INT + (pit_date IS NOT NULL)::INT AS present FROM temporal_facts),
o AS (SELECT *, row_number() OVER (PARTITION BY a, s, p ORDER BY trust DESC, present DESC, built_at DESC, v, start_date, end_date) AS n, count(*) OVER (PARTITION BY a, s, p) AS k FROM t WHERE a IS NOT NULL AND s IS NOT NULL AND p IS NOT NULL),
b AS (SELECT * FROM o WHERE n = 1 AND k > 1)
SELECT CAST(b.a AS VARCHAR) AS anchor_date, 'Q' || b.s AS subject_qid, 'P' || b.p AS pid, 'Q' || b.v AS value_qid, CASE b.trust WHEN 2 THEN 'preferred' WHEN 1 THEN 'normal' ELSE 'deprecated' END AS rank,
  COALESCE((SELECT CAST(o.start_date AS VARCHAR) FROM o WHERE o.a = b.a AND o.s = b.s AND o.p = b.p AND o.v = b.v AND o.start_date IS NOT NULL ORDER BY o.n LIMIT 1), '') AS start_date,
  COALESCE((SELECT CAST(o.end_date AS VARCHAR) FROM o WHERE o.a = b.a AND o.s = b.s AND o.p = b.p AND o.v = b.v AND o.end_date IS NOT NULL ORDER BY o.n LIMIT 1), '') AS end_date FROM b"""


def p6_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The one label of each item and language: among all its rows, the one closest to what they agree on, live rows counting double."""
    rows = table(spark, folder, "labels").select(item_number("id").alias("q"), "lang", F.nullif(F.trim("label"), F.lit("")).alias("label"), F.when(F.col("deleted_at").isNull(), 2).otherwise(1).alias("w"))
    kept = consensus.consensus(rows.filter(F.col("q").isNotNull()), ["q", "lang"], "label", "w")
    return kept.select(item_id("q").alias("id"), "lang", F.col("value").alias("label"), "n_rows", "n_values", "distance")


# 8. Encoding of the whole corpus


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode(table(spark, folder, "documents"), "doc_id", "text", "byte_bpe_50k.tiktoken")


# 9. Mixing sources to target weights


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return checkpoint(tokenizer.count_tokens(table(spark, folder, "documents").select("doc_id", "source", "text"), "text"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_sized(spark, folder), table(spark, folder, "mix_targets"), "doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    docs, targets = _sized(spark, folder), table(spark, folder, "mix_targets")
    return mixing.mix_report(mixing.mix(docs, targets, "doc_id"), docs, targets)


# 10. Sentence boundaries


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.split_sentences(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p6_found, p6_labels, p8_ids, p9_mix, p9_shares, p10_found)}
SQL = {"p6_found": P6_FOUND_SQL}
