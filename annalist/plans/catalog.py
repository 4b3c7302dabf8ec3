"""Queries of the engine's own operators over the test tables, and their SQL."""

from __future__ import annotations

from functools import wraps
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import days_of, first_day, last_day, parse_day, same_year, scope_year, sql_day, sql_days
from ..functions.ids import item_id, item_number, property_id, property_number, rank_name, sql_item, sql_property
from ..operators import evaluate as E
from ..operators import generate as G
from ..operators.claims import extract_claims
from ..operators.joins import annotate_present, complement_join, consecutive_anchors, hop_join, pair_neighbours, three_hop_join
from ..operators.labels import attach_labels, build_labels, known_properties, one_label, with_known_ids
from ..operators.sampling import cap_rows, stratified_sample
from ..operators.truth import best_rows, best_truth, build_truth, rank_score, with_days
from ..schemas import ITEM_QUALIFIERS, MAIN_PROPERTIES, QUALIFIERS, TEXT_QUALIFIERS, TIME_QUALIFIERS
from ..session import checkpoint, checkpoint_folder, table
from ..sources.readers import read_chains
from ..sources.sinks import write_jsonl
from . import sqltext as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def dates_as_text(df: DataFrame) -> DataFrame:
    """Dates as ``YYYY-MM-DD``, so that results compare alike in any engine."""
    return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})


def query(sql: str | None = None, dates: str = ""):
    """Registers a query under its function's name, with its SQL if there is one; ``dates`` are the SQL's date columns, given as text."""

    def register(f):
        @wraps(f)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return dates_as_text(f(spark, folder))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({d} AS VARCHAR) AS {d}' for d in dates.split())}) FROM ({sql})" if dates else sql
        return run

    return register


# Adapters


def base_claims(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "claims").select("snapshot_year", item_id(item_number("subject_qid")).alias("subject_qid"), property_id(property_number("pid")).alias("pid"), item_id(item_number("value_qid")).alias("value_qid"), rank_name("rank").alias("rank"), *QUALIFIERS.values())
    return with_days(rows)


def clean_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = build_labels(table(spark, folder, "labels"), "en").select(item_id(item_number("id")).alias("id"), "label")
    return one_label(rows.filter(X.is_clean_label("label")))


def facts(spark: SparkSession, folder: str) -> DataFrame:
    name = rank_name("rank", None)
    trust = F.when(name == "preferred", 2).when(name == "normal", 1).when(name == "deprecated", 0).otherwise(F.coalesce("rank_score", F.lit(1)))
    rows = table(spark, folder, "temporal_facts").select(
        "snapshot_year", "anchor_date", F.lit("temporal").alias("truth_type"), item_id(item_number("subject_qid")).alias("subject_qid"), property_id(property_number("pid")).alias("pid"), item_id(item_number("value_qid")).alias("value_qid"), trust.alias("rank_score"), "start_date", "end_date", "pit_date"
    )
    return rows.distinct()


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return attach_labels(known_properties(rows), labels, clean=False).withColumn("year", scope_year("pit_date", "start_date", "end_date"))


def rich_best(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All active temporal rows and the best of each subject and property, both with labels and qualifier year."""
    rows, labels = facts(spark, folder), clean_labels(spark, folder)
    return _labelled(rows, labels), _labelled(best_rows(rows, ["anchor_date", "subject_qid", "pid"]), labels)


# Truth at anchor dates

_TRUTH = S.truth(("01-01", "04-01", "07-01", "10-01"))
_QUALIFIERS = [c for c in QUALIFIERS.values() if c not in ("q_start_time", "q_end_time", "q_point_in_time")]
_DATED = ["snapshot_year", "anchor_date", "subject_qid", "pid", "value_qid", "rank", "rank_score", "start_date", "end_date", "pit_date"]


def _truth(spark: SparkSession, folder: str, kind: str, best: bool) -> DataFrame:
    """Rows at all four anchors; all of them with the qualifiers they carry, as texts."""
    rows = build_truth(base_claims(spark, folder)).filter(F.col("truth_type") == kind)
    carried = [] if best else [F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) for c in _QUALIFIERS]
    return (best_truth(rows) if best else rows).select(*(_DATED if kind == "temporal" else _DATED[:7]), *carried)


def _truth_sql(kind: str, rows: str) -> str:
    carried = [] if rows == "best" else [f"COALESCE(array_to_string({c}, '|'), '') AS {c}" for c in _QUALIFIERS]
    return f"WITH {_TRUTH} SELECT {', '.join([*(_DATED if kind == 'temporal' else _DATED[:7]), *carried])} FROM {rows} WHERE truth_type = '{kind}'"


@query(_truth_sql("temporal", "best"), "anchor_date start_date end_date pit_date")
def truth_temporal_best(spark, folder):
    return _truth(spark, folder, "temporal", True)


@query(_truth_sql("temporal", "truth"), "anchor_date start_date end_date pit_date")
def truth_temporal_all(spark, folder):
    return _truth(spark, folder, "temporal", False)


@query(_truth_sql("timeless", "best"), "anchor_date")
def truth_timeless_best(spark, folder):
    return _truth(spark, folder, "timeless", True)


@query(_truth_sql("timeless", "truth"), "anchor_date")
def truth_timeless_all(spark, folder):
    return _truth(spark, folder, "timeless", False)


@query("SELECT event_type, count(*) FILTER (WHERE year(ts) = 2024) AS n_same, count(*) FILTER (WHERE ts IS NULL OR year(ts) <> 2024) AS n_other FROM events GROUP BY event_type")
def truth_pit_events(spark, folder):
    """Events as points in time: how many hold at an anchor of 2024."""
    same = same_year(F.col("ts").cast("date"), F.to_date(F.lit("2024-07-01")))
    return table(spark, folder, "events").groupBy("event_type").agg(F.count(F.when(same, 1)).alias("n_same"), F.count(F.when(~same, 1)).alias("n_other"))


# Entity documents, labels


_MAIN = ", ".join(f"'{p}'" for p in MAIN_PROPERTIES)
_DOC_CLAIMS = f"""r AS (SELECT row_no, snapshot_year, regexp_replace(regexp_replace(line, '^[\\s\\x{{FEFF}}]+|\\s+$', '', 'g'), '\\s*,$', '') AS t FROM entity_docs WHERE line IS NOT NULL),
d AS (SELECT row_no, snapshot_year, CASE WHEN starts_with(t, '{{') AND suffix(t, '}}') AND json_valid(t) THEN t END AS t FROM r),
docs AS (SELECT row_no, snapshot_year, t ->> '$.id' AS subject_qid, t -> '$.claims' AS claims FROM d WHERE t IS NOT NULL),
k AS (SELECT * EXCLUDE claims, claims -> pid AS list FROM (SELECT *, unnest(json_keys(claims)) AS pid FROM docs WHERE starts_with(subject_qid, 'Q') AND json_type(claims) = 'OBJECT') WHERE pid IN ({_MAIN})),
c AS (SELECT * EXCLUDE list, unnest(from_json(list, '["JSON"]')) AS claim FROM k WHERE json_type(list) = 'ARRAY')"""
_item_sql = lambda x: f"CASE WHEN ({x} ->> '$.snaktype') = 'value' AND ({x} ->> '$.datavalue.value.entity-type') = 'item' AND regexp_full_match({x} ->> '$.datavalue.value.numeric-id', '[0-9]+') THEN 'Q' || ({x} ->> '$.datavalue.value.numeric-id') END"
_time_sql = lambda x: f"json_extract_string({x}, '$.datavalue.value.time')"
_day_text_sql = lambda x: f"CASE WHEN ({x} ->> '$.snaktype') = 'value' THEN CAST({sql_day(_time_sql(x))} AS VARCHAR) END"
_text_sql = lambda x: f"CASE WHEN ({x} ->> '$.snaktype') = 'value' AND json_type({x} -> '$.datavalue.value') = 'VARCHAR' AND NOT starts_with({x} ->> '$.datavalue.value', '{{') THEN {x} ->> '$.datavalue.value' END"


def _qualifier_sql(pid: str, value) -> str:
    """Values of a qualifier as a list, null for none."""
    found = f"list_filter(list_transform(from_json(claim -> '$.qualifiers.{pid}', '[\"JSON\"]'), lambda q: {value('q')}), lambda z: z IS NOT NULL)"
    return f"CASE WHEN json_type(claim -> '$.qualifiers.{pid}') = 'ARRAY' AND len({found}) > 0 THEN {found} END"


_SHAPES = {**{p: _day_text_sql for p in TIME_QUALIFIERS}, **{p: _item_sql for p in ITEM_QUALIFIERS}, **{p: _text_sql for p in TEXT_QUALIFIERS}}


def _claims_sql(rest: str) -> str:
    return f"""WITH {_DOC_CLAIMS} SELECT row_no, snapshot_year, subject_qid, pid, {_item_sql("(claim -> '$.mainsnak')")} AS value_qid, COALESCE(claim ->> '$.rank', 'normal') AS rank, {rest} FROM c
WHERE json_type(claim) = 'OBJECT' AND COALESCE(claim ->> '$.rank', 'normal') <> 'deprecated' AND {_item_sql("(claim -> '$.mainsnak')")} IS NOT NULL"""


def _lists_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "|") for c, t in df.dtypes if t == "array<string>"})


@query(_claims_sql(", ".join(f"array_to_string({_qualifier_sql(p, _SHAPES[p])}, '|') AS {c}" for p, c in QUALIFIERS.items())))
def claims_flatten_json(spark, folder):
    """Claims of the entity documents with their qualifier lists, given as texts."""
    return _lists_as_text(extract_claims(table(spark, folder, "entity_docs"), "line", F.col("snapshot_year"), keep=["row_no"]))


@query(_claims_sql(", ".join(f"({_qualifier_sql(p, _day_text_sql)})[1] AS {c}" for p, c in {"P580": "start_time", "P582": "end_time", "P585": "point_in_time"}.items())))
def claims_first_qualifiers(spark, folder):
    """The variant with the first valid day of each time qualifier."""
    return extract_claims(table(spark, folder, "entity_docs"), "line", F.col("snapshot_year"), keep=["row_no"], qualifier_mode="first")


@query(f"WITH {S.BASE}, k AS (SELECT DISTINCT 'Q' || {sql_item('id')} AS id FROM labels) SELECT snapshot_year, subject_qid, pid, value_qid, rank FROM base WHERE subject_qid IN (SELECT id FROM k WHERE id IS NOT NULL) AND value_qid IN (SELECT id FROM k WHERE id IS NOT NULL)")
def label_semi_join(spark, folder):
    ids = table(spark, folder, "labels").select(item_id(item_number("id")).alias("id"))
    return with_known_ids(base_claims(spark, folder), ids, "id").select("snapshot_year", "subject_qid", "pid", "value_qid", "rank")


@query(f"WITH {S.BASE}, {S.LABELS} SELECT b.snapshot_year, b.subject_qid, s.label AS subject_label, b.pid, b.value_qid, v.label AS value_label FROM base b JOIN lab s ON s.id = b.subject_qid JOIN lab v ON v.id = b.value_qid")
def label_attach_clean(spark, folder):
    return attach_labels(base_claims(spark, folder), clean_labels(spark, folder), clean=False).select("snapshot_year", "subject_qid", "subject_label", "pid", "value_qid", "value_label")


@query("SELECT id, label, lang, description FROM labels WHERE lang = 'fr'")
def label_language_filter(spark, folder):
    return build_labels(table(spark, folder, "labels"), "fr")


@query(f"SELECT id, label, {S.clean_label('label')} AS is_clean FROM labels")
def clean_label_flag(spark, folder):
    return table(spark, folder, "labels").select("id", "label", X.is_clean_label("label").alias("is_clean"))


# Days

_TIME_SQL = "SELECT unnest(q_start_time) AS t FROM claims UNION ALL SELECT unnest(q_end_time) FROM claims UNION ALL SELECT unnest(q_point_in_time) FROM claims"


@query(f"SELECT t, {sql_day('t')} AS day, count(*) AS n FROM ({_TIME_SQL}) GROUP BY ALL", "day")
def date_parse(spark, folder):
    texts = F.flatten(F.array_compact(F.array("q_start_time", "q_end_time", "q_point_in_time")))
    return table(spark, folder, "claims").select(F.explode(texts).alias("t")).groupBy("t", parse_day("t").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT snapshot_year, subject_qid, pid, value_qid, {S.days('q_start_time', 'min')} AS first_day, {S.days('q_end_time', 'max')} AS last_day, CAST(len({sql_days('q_point_in_time')}) AS INT) AS n_days FROM claims", "first_day last_day")
def date_list_min_max(spark, folder):
    return table(spark, folder, "claims").select("snapshot_year", "subject_qid", "pid", "value_qid", first_day("q_start_time").alias("first_day"), last_day("q_end_time").alias("last_day"), F.size(days_of("q_point_in_time")).alias("n_days"))


@query("SELECT anchor_date, subject_qid, pid, value_qid, CAST(COALESCE(year(COALESCE(pit_date, start_date, end_date)), 0) AS INT) AS year FROM temporal_facts", "anchor_date")
def year_coalesce(spark, folder):
    return table(spark, folder, "temporal_facts").select("anchor_date", "subject_qid", "pid", "value_qid", F.coalesce(scope_year("pit_date", "start_date", "end_date"), F.lit(0)).alias("year"))


# Joins

_PAIR = "a.anchor_date, a.subject_label, a.pid, a.value_label, b.pid AS b_pid, b.value_label AS b_value_label"


@query(f"WITH {S.FACTS} SELECT {_PAIR} FROM one a JOIN one b ON a.anchor_date = b.anchor_date AND a.subject_label = b.subject_label AND b.pid = {S.complement('a.pid')}", "anchor_date")
def complement_pairs(spark, folder):
    best = rich_best(spark, folder)[1]
    return complement_join(best, ["anchor_date", "subject_label"]).select("anchor_date", "subject_label", "pid", "value_label", "b_pid", "b_value_label")


_NAMED = f"{_TRUTH}, {S.LABELS}, named AS (SELECT DISTINCT b.anchor_date, s.label AS subject_label, b.pid, v.label AS value_label FROM best b JOIN lab s ON s.id = b.subject_qid JOIN lab v ON v.id = b.value_qid)"


def _named_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Best rows at every anchor by labels; statements with and without dates."""
    best = best_truth(build_truth(base_claims(spark, folder)))
    return attach_labels(best, clean_labels(spark, folder), clean=False).select("anchor_date", "subject_label", "pid", "value_label").distinct()


_TWO = f"""two AS (SELECT * EXCLUDE n FROM (SELECT a.*, b.pid AS n_pid, b.value_label AS n_value_label,
  row_number() OVER (PARTITION BY a.anchor_date, a.subject_label, a.pid, a.value_label ORDER BY b.pid, b.value_label) AS n
  FROM named a JOIN (VALUES {S.HOP_RULES}) r(p, q) ON r.p = a.pid JOIN named b ON b.anchor_date = a.anchor_date AND b.subject_label = a.value_label AND b.pid = r.q) WHERE n = 1)"""


@query(f"WITH {_NAMED}, {_TWO} SELECT * FROM two", "anchor_date")
def two_hop_first(spark, folder):
    return hop_join(_named_rows(spark, folder), ["anchor_date"]).select("anchor_date", "subject_label", "pid", "value_label", "n_pid", "n_value_label")


_THREE = ("P131", "P131", "P17")


@query(
    f"""WITH {_NAMED}, f AS (SELECT anchor_date, subject_label, pid, min(value_label) AS value_label FROM named GROUP BY ALL)
SELECT a.anchor_date, a.subject_label, a.value_label, b.value_label AS n_value_label, c.value_label AS t_value_label FROM named a
JOIN f b ON b.anchor_date = a.anchor_date AND b.subject_label = a.value_label AND b.pid = 'P131' JOIN f c ON c.anchor_date = a.anchor_date AND c.subject_label = b.value_label AND c.pid = 'P17' WHERE a.pid = 'P131'""",
    "anchor_date",
)
def three_hop_first(spark, folder):
    met = three_hop_join(_named_rows(spark, folder), ["anchor_date"], _THREE)
    return met.select("anchor_date", "subject_label", "value_label", "n_value_label", "t_value_label")


@query(
    f"""WITH {S.FACTS}, last AS (SELECT subject_label, pid, min(value_label) AS now FROM best WHERE anchor_date = (SELECT max(anchor_date) FROM best) GROUP BY ALL)
SELECT b.anchor_date, b.subject_label, b.pid, b.value_label, l.now AS present_day_answer, COALESCE(l.now <> b.value_label, FALSE) AS drift_eligible FROM best b LEFT JOIN last l ON l.subject_label = b.subject_label AND l.pid = b.pid""",
    "anchor_date",
)
def present_day_drift(spark, folder):
    best = rich_best(spark, folder)[1]
    last = best.agg(F.max("anchor_date").alias("_last"))
    present = best.join(F.broadcast(last), F.col("anchor_date") == F.col("_last"), "left_semi")
    return annotate_present(best, present, answer="value_label").select("anchor_date", "subject_label", "pid", "value_label", "present_day_answer", "drift_eligible")


@query(
    f"""WITH {S.FACTS}, d AS (SELECT anchor_date, lead(anchor_date) OVER (PARTITION BY snapshot_year ORDER BY anchor_date) AS next_anchor FROM (SELECT DISTINCT snapshot_year, anchor_date FROM best)),
m AS (SELECT a.anchor_date, d.next_anchor, a.subject_label, a.pid, a.value_label, b.value_label AS b_value_label FROM one a JOIN d USING (anchor_date) JOIN one b ON b.snapshot_year = a.snapshot_year AND b.anchor_date = d.next_anchor AND b.subject_label = a.subject_label AND b.pid = a.pid)
SELECT * FROM m WHERE (anchor_date, subject_label) IN (SELECT (anchor_date, subject_label) FROM m GROUP BY anchor_date, subject_label HAVING count(DISTINCT pid) >= 2)""",
    "anchor_date next_anchor",
)
def cross_anchor_common(spark, folder):
    met = consecutive_anchors(rich_best(spark, folder)[1], ["subject_label"])
    return met.select("anchor_date", "next_anchor", "subject_label", "pid", "value_label", "b_value_label")


@query(
    f"""WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {S.seeded("'42'", 'c_mktsegment', 'c_custkey')}, c_custkey) AS n FROM customer)
SELECT c_mktsegment, (n - 1) // 2 AS pair_no, min_by(c_custkey, n) AS a, max_by(c_custkey, n) AS b FROM r GROUP BY c_mktsegment, (n - 1) // 2 HAVING count(*) = 2"""
)
def pair_neighbours_by_segment(spark, folder):
    return pair_neighbours(table(spark, folder, "customer"), ["c_mktsegment"], "c_custkey", 42, None)


# Generated families: flat questions, and chains by turns

_KEYS = ["anchor_date", "subject_label", "pid", "question", "answer"]


def _flat_sql(rows: str) -> str:
    return f"WITH {S.FACTS}, q AS ({rows}) SELECT anchor_date, subject_label, pid, question, answer FROM q WHERE {S.good_question('question', 'answer')}"


@query(_flat_sql(f"SELECT a.anchor_date, a.subject_label, a.pid, {S.explicit()} AS question, a.value_label AS answer FROM one a"), "anchor_date")
def direct_questions(spark, folder):
    return G.direct(rich_best(spark, folder)[1]).select(*_KEYS)


_COUNTS = f"SELECT snapshot_year, anchor_date, subject_label, pid, count(DISTINCT value_label) AS n FROM rich WHERE pid IN ({', '.join(repr(p) for p in S.COUNTED)}) GROUP BY ALL"


@query(_flat_sql(f"SELECT anchor_date, subject_label, pid, 'How many ' || {S.plural('(' + S.by_pid('pid', 2) + ')')} || ' did ' || subject_label || ' have in ' || snapshot_year || '?' AS question, CAST(n AS VARCHAR) AS answer FROM ({_COUNTS}) WHERE n >= 2"), "anchor_date")
def count_distinct_questions(spark, folder):
    return G.count_distinct(rich_best(spark, folder)[0]).select(*_KEYS)


@query(f"WITH {S.FACTS} SELECT snapshot_year, anchor_date, subject_label, pid, n AS n_values FROM ({_COUNTS}) WHERE n >= 2", "anchor_date")
def count_distinct_values(spark, folder):
    counts = G.value_counts(rich_best(spark, folder)[0], ["snapshot_year", "anchor_date", "subject_label", "pid"])
    return counts.filter("n_values >= 2").drop("subject_qid")


def _two_sql(word: str, value: str, where: str) -> str:
    return f"""WITH {S.FACTS}, c AS (SELECT snapshot_year, anchor_date, truth_type, pid, year, subject_label, count(DISTINCT value_label) AS n FROM rich WHERE year IS NOT NULL AND pid IN ({', '.join(repr(p) for p in S.COUNTED)}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_year, anchor_date, truth_type, pid, year ORDER BY {S.seeded("'42'", 'snapshot_year', 'anchor_date', 'truth_type', 'pid', 'year', 'subject_label')}, subject_label) AS k FROM c),
p AS (SELECT a.anchor_date, a.pid, a.year, a.subject_label AS a, b.subject_label AS b, a.n AS n_a, b.n AS n_b FROM r a JOIN r b ON a.anchor_date = b.anchor_date AND a.snapshot_year = b.snapshot_year AND a.pid = b.pid AND a.year = b.year AND b.k = a.k + 1 AND a.k % 2 = 1)
SELECT anchor_date, pid, CAST(year AS INT) AS year, a, b, {value} AS result FROM p WHERE {where}"""


def _pairs(spark, folder) -> DataFrame:
    return G.two_entities(rich_best(spark, folder)[0], 42, None)


@query(_two_sql("together the", "n_a + n_b", "TRUE"), "anchor_date")
def sum_two_entities(spark, folder):
    return _pairs(spark, folder).select("anchor_date", "pid", "year", "a", "b", (F.col("n_a") + F.col("n_b")).alias("result"))


@query(_two_sql("the difference in", "n_a - n_b", "n_a <> n_b"), "anchor_date")
def diff_two_entities(spark, folder):
    return _pairs(spark, folder).filter("n_a <> n_b").select("anchor_date", "pid", "year", "a", "b", (F.col("n_a") - F.col("n_b")).alias("result"))


_TURNS = ["family", "anchor_date", "turn_index", "question", "answer", "year", "pid", "subject_label", "value_label"]


def _turns(df: DataFrame) -> DataFrame:
    return G.turn_rows(df).select(*_TURNS)


def _chain_sql(family: str, with_: str, key: str, base: str = S.FACTS) -> str:
    """``with_`` ends in a table ``t`` of turns with a chain's ``key`` and turn_index; the gate is applied by chain."""
    return f"""WITH {base}, {with_}, ok AS (SELECT {key} FROM t GROUP BY {key} HAVING bool_and({S.good_question('question', 'answer')}) AND count(DISTINCT lower({S.squeeze('question')})) = count(*)
  AND (count(*) < 3 OR count(DISTINCT lower({S.squeeze('answer')})) > 1))
SELECT '{family}' AS family, anchor_date, CAST(turn_index AS INT) AS turn_index, question, answer, CAST(year AS INT) AS year, pid, subject_label, value_label FROM t WHERE ({key}) IN (SELECT ({key}) FROM ok)"""


def _two_turns_sql(family: str, pairs: str, second: str, year_a: str = "a_snapshot_year", year_b: str = "b_snapshot_year", first: str | None = None) -> str:
    first = first or S.explicit("x").replace("x.", "x.a_")
    return _chain_sql(
        family,
        f"""pairs AS (SELECT row_number() OVER () AS k, * FROM ({pairs})),
t AS (SELECT k, a_anchor_date AS anchor_date, 0 AS turn_index, {first} AS question, a_value_label AS answer, {year_a} AS year, a_pid AS pid, a_subject_label AS subject_label, a_value_label AS value_label FROM pairs x
  UNION ALL SELECT k, b_anchor_date, 1, {second}, b_value_label, {year_b}, b_pid, b_subject_label, b_value_label FROM pairs x)""",
        "k",
    )


_SIDES = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in ("snapshot_year", "anchor_date", "truth_type", "subject_label", "subject_qid", "pid", "value_label", "value_qid", "year"))
_COMPLETED = f"SELECT {_SIDES} FROM one a JOIN one b ON a.snapshot_year = b.snapshot_year AND a.anchor_date = b.anchor_date AND a.subject_label = b.subject_label AND b.pid = {S.complement('a.pid')}"


@query(_two_turns_sql("carryover", _COMPLETED, S.question("followup", "b_pid", key="a_subject_label")), "anchor_date")
def carryover_chains(spark, folder):
    return _turns(G.carryover(rich_best(spark, folder)[1]))


@query(_two_turns_sql("carryover_then", _COMPLETED, S.question("followup_then", "b_pid", key="a_subject_label")), "anchor_date")
def carryover_then_chains(spark, folder):
    return _turns(G.carryover(rich_best(spark, folder)[1], then=True))


_CROSS = f"""SELECT {_SIDES} FROM ranked r1 JOIN ranked r2 ON r1.anchor_date = r2.anchor_date AND r1.snapshot_year = r2.snapshot_year AND r1.pid = r2.pid AND r2.k = r1.k + 1 AND r1.k % 2 = 1
  JOIN best a ON a.anchor_date = r1.anchor_date AND a.snapshot_year = r1.snapshot_year AND a.pid = r1.pid AND a.subject_qid = r1.subject_qid
  JOIN best b ON b.anchor_date = r2.anchor_date AND b.snapshot_year = r2.snapshot_year AND b.pid = r2.pid AND b.subject_qid = r2.subject_qid WHERE a.subject_label <> b.subject_label"""
_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY snapshot_year, anchor_date, pid ORDER BY {S.seeded(chr(39) + '42' + chr(39), 'snapshot_year', 'anchor_date', 'truth_type', 'pid', 'subject_qid')}, subject_qid) AS k FROM (SELECT DISTINCT snapshot_year, anchor_date, truth_type, pid, subject_qid FROM best))"
_THEN_FOR = f"('Turning to ' || b_subject_label || ': ' || lower({S.question('followup_then', 'b_pid', key='b_subject_label')}))"


@query(_two_turns_sql("cross_entity_then", _CROSS, _THEN_FOR).replace("pairs AS (SELECT row_number()", _RANKED + ", pairs AS (SELECT row_number()", 1), "anchor_date")
def cross_entity_then_chains(spark, folder):
    return _turns(G.cross_entity_then(rich_best(spark, folder)[1], 42, None))


_YEARS = f"""years AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_year, anchor_date, subject_label, pid, year ORDER BY {S.seeded(chr(39) + '42' + chr(39), 'value_qid')}, value_qid, value_label, subject_qid) AS n FROM rich WHERE year IS NOT NULL) WHERE n = 1),
picked AS (SELECT *, row_number() OVER (PARTITION BY snapshot_year, anchor_date, subject_label, pid ORDER BY {S.seeded(chr(39) + '42' + chr(39), 'subject_label', 'year')}, year) AS k FROM years)"""


@query(
    _two_turns_sql(
        "scope_switch", f"SELECT {_SIDES} FROM picked a JOIN picked b ON a.snapshot_year = b.snapshot_year AND a.anchor_date = b.anchor_date AND a.subject_label = b.subject_label AND a.pid = b.pid AND a.k = 1 AND b.k = 2",
        S.question("switch", "a_pid", year="b_year", key="a_subject_label"), "a_year", "b_year", S.question("explicit_temporal", "a_pid", "a_subject_label", "a_year", "a_subject_label"),
    ).replace("pairs AS (SELECT row_number()", _YEARS + ", pairs AS (SELECT row_number()", 1),
    "anchor_date",
)
def scope_switch_chains(spark, folder):
    return _turns(G.scope_switch(rich_best(spark, folder)[0]))


@query(
    _chain_sql(
        "temporal_narrative",
        f"""{_YEARS}, placed AS (SELECT *, row_number() OVER (PARTITION BY snapshot_year, anchor_date, subject_label, pid ORDER BY year) AS i, count(*) OVER (PARTITION BY snapshot_year, anchor_date, subject_label, pid) AS n FROM picked WHERE k <= 6),
t AS (SELECT snapshot_year, anchor_date, subject_label, pid, i - 1 AS turn_index, CASE WHEN i = 1 THEN {S.question('explicit_temporal', 'pid', 'subject_label', 'year', 'subject_label')}
  WHEN i = n AND i > 2 AND {S.coin(50, "'42'", 'subject_label', 'pid')} THEN {S.question('by_year', 'pid', year='year', key='subject_label')}
  ELSE {S.question('switch', 'pid', year='year', key="concat_ws('|', subject_label, year)")} END AS question, value_label AS answer, year, value_label FROM placed WHERE n >= 3)""",
        "snapshot_year, anchor_date, subject_label, pid",
    ),
    "anchor_date",
)
def temporal_narrative_chains(spark, folder):
    return _turns(G.temporal_narrative(rich_best(spark, folder)[0]))


_CP_Q = {
    0: S.question("explicit_temporal", "pid", "subject_label", "year", "subject_label"),
    1: S.question("followup_then", "b_pid", key="concat_ws('|', subject_label, 'a')"),
    2: f"('Back to ' || ({S.by_pid('pid', 2)}) || ': ' || lower({S.question('switch', 'pid', year='year', key='subject_label')}))",
    3: f"('And in ' || year || ', ' || lower({S.question('followup_then', 'b_pid', key=chr(99) + 'oncat_ws(' + chr(39) + '|' + chr(39) + ', subject_label, ' + chr(39) + 'b' + chr(39) + ')')}))",
}
_CP_T = " UNION ALL ".join(f"SELECT snapshot_year, anchor_date, subject_label, pid AS kp, {i} AS turn_index, {_CP_Q[i]} AS question, {'b_' if i % 2 else ''}value_label AS answer, year, {'b_' if i % 2 else ''}pid AS pid, {'b_' if i % 2 else ''}value_label AS value_label FROM e WHERE {'last' if i > 1 else 'first'}" for i in range(4))


@query(
    _chain_sql(
        "change_point",
        f"""{_YEARS}, m AS (SELECT a.snapshot_year, a.anchor_date, a.subject_label, a.pid, a.year, a.value_label, b.pid AS b_pid, b.value_label AS b_value_label FROM years a JOIN years b ON a.snapshot_year = b.snapshot_year AND a.anchor_date = b.anchor_date AND a.subject_label = b.subject_label AND a.year = b.year AND b.pid = {S.complement('a.pid')}),
e AS (SELECT *, year = min(year) OVER w AS first, year = max(year) OVER w AS last, min(year) OVER w < max(year) OVER w AS two FROM m WINDOW w AS (PARTITION BY snapshot_year, anchor_date, subject_label, pid) QUALIFY two),
t AS ({_CP_T})""",
        "snapshot_year, anchor_date, subject_label, kp",
    ),
    "anchor_date",
)
def change_point_chains(spark, folder):
    return _turns(G.change_point(rich_best(spark, folder)[0]))


# Orders as facts about customers, for families that the facts of the test tables give no row of.

_ORDER_FACTS = """rich AS (SELECT 1998 AS snapshot_year, DATE '1998-01-01' AS anchor_date, CASE WHEN o_custkey % 4 = 0 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'timeless' ELSE 'temporal' END AS truth_type, 'Customer ' || o_custkey AS subject_label, 'Q' || o_custkey AS subject_qid,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'P6' WHEN '2-HIGH' THEN 'P35' ELSE 'P108' END AS pid, 'Order ' || o_orderkey AS value_label, 'Q' || o_orderkey AS value_qid, CAST(year(o_orderdate) AS INT) AS year FROM orders)"""


def _order_facts(spark: SparkSession, folder: str) -> DataFrame:
    pid = F.when(F.col("o_orderpriority") == "1-URGENT", "P6").when(F.col("o_orderpriority") == "2-HIGH", "P35").otherwise("P108")
    named = lambda word, key: F.concat(F.lit(word), F.col(key).cast("string"))
    return table(spark, folder, "orders").select(
        F.lit(1998).alias("snapshot_year"), F.to_date(F.lit("1998-01-01")).alias("anchor_date"), F.when((F.col("o_custkey") % 4 == 0) & (pid == "P108"), "timeless").otherwise("temporal").alias("truth_type"),
        named("Customer ", "o_custkey").alias("subject_label"), named("Q", "o_custkey").alias("subject_qid"), pid.alias("pid"), named("Order ", "o_orderkey").alias("value_label"), named("Q", "o_orderkey").alias("value_qid"), F.year("o_orderdate").alias("year")
    )


@query(SQL["change_point_chains"].replace(S.FACTS, _ORDER_FACTS, 1).replace("WHERE year IS NOT NULL)", "WHERE year IS NOT NULL AND truth_type = 'temporal')", 1), "")
def change_point_orders(spark, folder):
    return _turns(G.change_point(_order_facts(spark, folder)))


@query(
    f"""WITH {_ORDER_FACTS}, n AS (SELECT anchor_date, truth_type, subject_label, pid, count(DISTINCT value_label) AS n FROM rich WHERE pid IN ({', '.join(repr(p) for p in S.COUNTED)}) GROUP BY ALL HAVING count(DISTINCT value_label) >= 2),
q AS (SELECT *, 'How many ' || {S.plural('(' + S.by_pid('pid', 2) + ')')} || CASE truth_type WHEN 'timeless' THEN ' does ' || subject_label || ' have?' ELSE ' did ' || subject_label || ' have in 1998?' END AS question, CAST(n AS VARCHAR) AS answer FROM n)
SELECT truth_type, anchor_date, subject_label, pid, question, answer FROM q WHERE {S.good_question('question', 'answer')}""",
    "anchor_date",
)
def count_distinct_orders(spark, folder):
    return G.count_distinct(_order_facts(spark, folder)).select("truth_type", *_KEYS)


def _anchor_best(spark: SparkSession, folder: str) -> DataFrame:
    """Best rows at every anchor, with and without dates, with labels."""
    best = best_truth(build_truth(base_claims(spark, folder)))
    return known_properties(attach_labels(best, clean_labels(spark, folder), clean=False)).withColumn("year", F.col("snapshot_year"))


@query()
def multi_turn_chains(spark, folder):
    return _turns(G.multi_turn_chain(_anchor_best(spark, folder)))


_ALL_NAMED = f"""{_TRUTH}, {S.LABELS}, nb AS (SELECT b.snapshot_year, b.anchor_date, b.truth_type, b.subject_qid, s.label AS subject_label, b.pid, b.value_qid, v.label AS value_label FROM best b JOIN lab s ON s.id = b.subject_qid JOIN lab v ON v.id = b.value_qid
  WHERE b.pid IN ({', '.join(repr(p[0]) for p in S.PROPERTIES)}))"""


def _hops_sql(rows: str) -> str:
    """CTEs two and three: questions over hops of the named rows, asked about the entity between."""
    key = "snapshot_year, anchor_date, truth_type"
    same = lambda a, b: f"{a}.snapshot_year = {b}.snapshot_year AND {a}.anchor_date = {b}.anchor_date AND {a}.truth_type = {b}.truth_type"
    m = lambda c: f"({S.by_pid(c, 2)})"
    return f"""f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}, subject_label, pid ORDER BY value_label, subject_qid, value_qid) AS n FROM {rows}) WHERE n = 1),
h2 AS (SELECT *, row_number() OVER (PARTITION BY {key}, a_subject_label, a_subject_qid, a_pid, a_value_label, a_value_qid ORDER BY pid) AS n FROM (SELECT a.subject_label AS a_subject_label, a.subject_qid AS a_subject_qid, a.pid AS a_pid, a.value_label AS a_value_label, a.value_qid AS a_value_qid, b.* EXCLUDE n
  FROM {rows} a JOIN (VALUES {S.HOP_RULES}) r(p, q) ON r.p = a.pid JOIN f1 b ON {same('a', 'b')} AND b.subject_label = a.value_label AND b.pid = r.q)),
two AS (SELECT 'multihop_2' AS family, {key}, a_value_label AS subject_label, a_value_qid AS subject_qid, pid, value_label, value_qid, snapshot_year AS year, value_label AS answer, 2 AS hops,
  'Taking the ' || {m('a_pid')} || ' of ' || a_subject_label || ', ' || ({S.by_pid('pid', 1)}) || ' is its ' || {m('pid')} || '?' AS question FROM h2 WHERE n = 1),
three AS (SELECT 'multihop_3' AS family, a.snapshot_year, a.anchor_date, a.truth_type, b.value_label AS subject_label, b.value_qid AS subject_qid, c.pid, c.value_label, c.value_qid, a.snapshot_year AS year, c.value_label AS answer, 3 AS hops,
  'Who is chief executive of the owner of the employer of ' || a.subject_label || '?' AS question FROM {rows} a JOIN f1 b ON {same('a', 'b')} AND b.subject_label = a.value_label AND a.pid = 'P108' AND b.pid = 'P127' JOIN f1 c ON {same('a', 'c')} AND c.subject_label = b.value_label AND c.pid = 'P169')"""


@query(f"WITH {_ALL_NAMED}, {_hops_sql('nb')} SELECT family, anchor_date, subject_label, pid, question, answer FROM (SELECT * FROM two UNION ALL SELECT * FROM three) WHERE {S.good_question('question', 'answer')}", "anchor_date")
def multihop_questions(spark, folder):
    best = _anchor_best(spark, folder)
    return G.multihop_2(best).unionByName(G.multihop_3(best)).select("family", *_KEYS)


_ALL_ONE = f"""{_ALL_NAMED}, one AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_year, anchor_date, truth_type, subject_label, pid ORDER BY {S.seeded("'42'", 'value_qid')}, value_qid, value_label, subject_qid) AS n FROM nb) WHERE n = 1)"""


@query(f"WITH {_ALL_ONE} SELECT truth_type, anchor_date, subject_label, pid, question, answer FROM (SELECT *, {S.explicit('one')} AS question, value_label AS answer FROM one) WHERE {S.good_question('question', 'answer')}", "anchor_date")
def direct_questions_all_truth(spark, folder):
    """Direct questions about temporal and timeless rows at every anchor."""
    return G.direct(_anchor_best(spark, folder)).select("truth_type", *_KEYS)


@query(
    _chain_sql("carryover", f"pairs AS (SELECT row_number() OVER () AS k, a.truth_type, a.snapshot_year, a.anchor_date, a.subject_label, a.pid, a.value_label, b.pid AS b_pid, b.value_label AS b_value_label FROM one a JOIN one b ON a.snapshot_year = b.snapshot_year AND a.anchor_date = b.anchor_date AND a.truth_type = b.truth_type AND a.subject_label = b.subject_label AND b.pid = {S.complement('a.pid')}),"
    f" t AS (SELECT k, anchor_date, 0 AS turn_index, {S.explicit('x')} AS question, value_label AS answer, snapshot_year AS year, pid, subject_label, value_label FROM pairs x UNION ALL SELECT k, anchor_date, 1, {S.question('followup', 'b_pid', key='subject_label')}, b_value_label, snapshot_year, b_pid, subject_label, b_value_label FROM pairs)", "k", _ALL_ONE),
    "anchor_date",
)
def carryover_chains_all_truth(spark, folder):
    """Carry-over chains of temporal and timeless rows at every anchor."""
    return _turns(G.carryover(_anchor_best(spark, folder)))


_CROSSED = f"""d AS (SELECT anchor_date, lead(anchor_date) OVER (PARTITION BY snapshot_year ORDER BY anchor_date) AS next_anchor FROM (SELECT DISTINCT snapshot_year, anchor_date FROM best)),
m AS (SELECT a.*, d.next_anchor, b.snapshot_year AS b_snapshot_year, b.value_label AS b_value_label FROM one a JOIN d USING (anchor_date) JOIN one b ON b.snapshot_year = a.snapshot_year AND b.anchor_date = d.next_anchor AND b.truth_type = a.truth_type AND b.subject_label = a.subject_label AND b.pid = a.pid),
placed AS (SELECT *, row_number() OVER (PARTITION BY truth_type, subject_label, anchor_date ORDER BY {S.seeded("'42'", 'subject_label', 'pid')}, pid) AS k, count(*) OVER (PARTITION BY truth_type, subject_label, anchor_date) AS n FROM m),
plan AS (SELECT *, CASE WHEN truth_type <> 'timeless' AND {S.coin(35, "'42'", 'subject_label', 'pid', "'form'")} THEN {S.question('followup_then', 'pid', key='subject_label')} ELSE {S.question('followup', 'pid', key='subject_label')} END AS next_question FROM placed
  WHERE n >= 2 AND k <= 2 + CAST('0x' || substr({S.seeded("'42'", 'subject_label', 'anchor_date', "'length'")}, 1, 8) AS BIGINT) % (least(4, n) - 1))"""
_CROSSED_TURNS = f"""SELECT anchor_date AS anchor_from, next_anchor AS anchor_to, CAST(0 AS INT) AS turn_index, {S.explicit('plan')} AS question, value_label AS answer, CAST(snapshot_year AS INT) AS year, pid, subject_label, value_label FROM plan WHERE k = 1
UNION ALL SELECT anchor_date, next_anchor, 1, next_question, value_label, snapshot_year, pid, subject_label, value_label FROM plan WHERE k = 2
UNION ALL SELECT anchor_date, next_anchor, 2, {S.question('switch', 'pid', year='b_snapshot_year', key='subject_label')}, b_value_label, b_snapshot_year, pid, subject_label, b_value_label FROM plan WHERE k = 1
UNION ALL SELECT anchor_date, next_anchor, CAST(k AS INT), next_question, b_value_label, b_snapshot_year, pid, subject_label, b_value_label FROM plan WHERE k > 2"""


@query(f"WITH {S.FACTS}, {_CROSSED} {_CROSSED_TURNS}", "anchor_from anchor_to")
def cross_anchor_chains(spark, folder):
    made = G.cross_anchor_switch(rich_best(spark, folder)[1])
    return made.select("anchor_from", "anchor_to", F.inline("turns")).drop("subject_qid", "value_qid")


# All families together

_COUNTED_SQL = f"SELECT 'complex_count_distinct' AS family, snapshot_year, anchor_date, 'temporal' AS truth_type, 'How many ' || {S.plural('(' + S.by_pid('pid', 2) + ')')} || ' did ' || subject_label || ' have in ' || snapshot_year || '?' AS question, CAST(n AS VARCHAR) AS answer, pid, subject_label, qid AS subject_qid, NULL AS value_label, NULL AS value_qid, snapshot_year AS year, 1 AS hops FROM (SELECT snapshot_year, anchor_date, subject_label, pid, count(DISTINCT value_label) AS n, min(subject_qid) AS qid FROM rich WHERE pid IN ({', '.join(repr(p) for p in S.COUNTED)}) GROUP BY ALL) WHERE n >= 2"


def _sums_sql(family: str, word: str, value: str, where: str) -> str:
    asked = f"'Counting {word} ' || {S.plural('(' + S.by_pid('pid', 2) + ')')} || ' of ' || a || ' and ' || b || ' in ' || year || ', what is the number?'"
    return f"SELECT '{family}' AS family, CAST(year(anchor_date) AS INT) AS snapshot_year, anchor_date, 'temporal' AS truth_type, {asked} AS question, CAST({value} AS VARCHAR) AS answer, pid, a || ' & ' || b AS subject_label, NULL AS subject_qid, NULL AS value_label, NULL AS value_qid, year, 1 AS hops FROM ep WHERE {where}"


_ENTITY_PAIRS = f"""ec AS (SELECT snapshot_year, anchor_date, truth_type, pid, year, subject_label, count(DISTINCT value_label) AS n FROM rich WHERE year IS NOT NULL AND pid IN ({', '.join(repr(p) for p in S.COUNTED)}) GROUP BY ALL),
er AS (SELECT *, row_number() OVER (PARTITION BY snapshot_year, anchor_date, truth_type, pid, year ORDER BY {S.seeded("'42'", 'snapshot_year', 'anchor_date', 'truth_type', 'pid', 'year', 'subject_label')}, subject_label) AS k FROM ec),
ep AS (SELECT a.anchor_date, a.pid, a.year, a.subject_label AS a, b.subject_label AS b, a.n AS n_a, b.n AS n_b FROM er a JOIN er b ON a.anchor_date = b.anchor_date AND a.snapshot_year = b.snapshot_year AND a.pid = b.pid AND a.year = b.year AND b.k = a.k + 1 AND a.k % 2 = 1)"""
_COLUMNS = "family, snapshot_year, anchor_date, truth_type, question, answer, pid, subject_label, subject_qid, value_label, value_qid, year, hops"
#: All flat questions (no cap is reached on the test tables), unique by wording.
_FLAT = f"""{S.FACTS}, {_ENTITY_PAIRS}, {_hops_sql('(SELECT snapshot_year, anchor_date, truth_type, subject_label, subject_qid, pid, value_label, value_qid FROM best)')},
asked AS (SELECT 0 AS place, 'direct' AS family, snapshot_year, anchor_date, truth_type, {S.explicit('one')} AS question, value_label AS answer, pid, subject_label, subject_qid, value_label, value_qid, snapshot_year AS year, 1 AS hops FROM one
  UNION ALL SELECT 1, {_COLUMNS} FROM two UNION ALL SELECT 2, {_COLUMNS} FROM three UNION ALL SELECT 3, {_COLUMNS} FROM ({_COUNTED_SQL})
  UNION ALL SELECT 4, {_COLUMNS} FROM ({_sums_sql('complex_sum_two_entities', 'together the', 'n_a + n_b', 'TRUE')}) UNION ALL SELECT 5, {_COLUMNS} FROM ({_sums_sql('complex_diff_two_entities', 'the difference in', 'n_a - n_b', 'n_a <> n_b')})),
flat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_year, anchor_date, truth_type, lower({S.squeeze('question')}) ORDER BY place, answer NULLS FIRST, year NULLS FIRST, pid NULLS FIRST, subject_label NULLS FIRST, subject_qid NULLS FIRST, value_label NULLS FIRST, value_qid NULLS FIRST) AS n FROM asked WHERE {S.good_question('question', 'answer')}) WHERE n = 1)"""
_NOW = "SELECT subject_label, pid, min(value_label) AS value_label, min_by(value_qid, (value_label, value_qid)) AS value_qid FROM best WHERE anchor_date = (SELECT max(anchor_date) FROM best) GROUP BY subject_label, pid"


def _made(spark, folder) -> tuple[DataFrame, DataFrame]:
    rich, best = (checkpoint(d) for d in rich_best(spark, folder))
    return G.all_flat(best, rich), G.all_chains(best, rich)


@query(
    f"""WITH {_FLAT}, p AS ({_NOW}) SELECT {', '.join('f.' + c.strip() for c in _COLUMNS.split(',') if c.strip() != 'year')}, CAST(f.year AS INT) AS year, TRUE AS temporal, starts_with(f.family, 'complex_') AS analytic, md5(concat_ws('|', f.family, f.snapshot_year, f.anchor_date, f.truth_type, f.question)) AS id,
  p.value_label AS present_day_answer, p.value_qid AS present_day_value_qid, COALESCE(p.value_label <> f.answer, FALSE) AS drift_eligible FROM flat f LEFT JOIN p ON p.subject_label = f.subject_label AND p.pid = f.pid""",
    "anchor_date",
)
def flat_dataset(spark, folder):
    """All flat questions with present-day answers."""
    rich, best = (checkpoint(d) for d in rich_best(spark, folder))
    last = best.agg(F.max("anchor_date").alias("_last"))
    present = best.join(F.broadcast(last), F.col("anchor_date") == F.col("_last"), "left_semi")
    return annotate_present(G.all_flat(best, rich), present).select("*", "difficulty.*").drop("difficulty")


@query()
def chain_dataset(spark, folder):
    """All chains of single anchors, by turns."""
    return _turns(_made(spark, folder)[1])


#: Chains by family and number of turns: those that have a last turn and no further one.
_CHAINS = " UNION ALL ".join(f"SELECT family, turn_index + 1 AS hops, count(*) AS n FROM ({SQL[q]}) GROUP BY ALL" for q in ("carryover_chains", "carryover_then_chains", "cross_entity_then_chains", "scope_switch_chains", "temporal_narrative_chains", "change_point_chains"))
_LENGTHS = f"WITH c AS ({_CHAINS}) SELECT family, hops, n - COALESCE(lead(n) OVER (PARTITION BY family ORDER BY hops), 0) AS n FROM c"


def _ruled(chains: DataFrame) -> DataFrame:
    """Without multi-turn chains, whose greedy choice SQL cannot make (``chain_dataset`` and ``multi_turn_chains`` have them)."""
    return chains.filter(F.col("family") != "multi_turn_chain")


@query(f"SELECT family, CAST(sum(n) AS BIGINT) AS n FROM (SELECT family, count(*) AS n FROM (WITH {_FLAT} SELECT family FROM flat) GROUP BY family UNION ALL SELECT family, n FROM ({_LENGTHS})) GROUP BY family HAVING sum(n) > 0")
def family_stats(spark, folder):
    flat, chains = _made(spark, folder)
    return G.family_stats(flat, _ruled(chains))


@query(f"SELECT family, CAST(hops AS INT) AS hops, TRUE AS temporal, starts_with(family, 'complex_') AS analytic, CAST(n AS BIGINT) AS n FROM (SELECT family, hops, count(*) AS n FROM (WITH {_FLAT} SELECT family, hops FROM flat) GROUP BY ALL UNION ALL SELECT family, hops, n FROM ({_LENGTHS})) WHERE n > 0")
def difficulty_struct(spark, folder):
    flat, chains = _made(spark, folder)
    both = flat.select("family", "difficulty.*").unionByName(_ruled(chains).select("family", "difficulty.*"))
    return both.groupBy("family", "hops", "temporal", "analytic").agg(F.count(F.lit(1)).alias("n"))


# Samples, gates


@query(f"SELECT * FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY {S.seeded(chr(39) + '42' + chr(39), 'o_orderkey')}, o_orderkey LIMIT 500)")
def cap_sample(spark, folder):
    return cap_rows(table(spark, folder, "orders"), 500, 42, ["o_orderkey"]).select("o_orderkey", "o_custkey")


_STRATA_SQL = f"""WITH h AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, {S.seeded(chr(39) + '42' + chr(39), 'o_orderkey')} AS h FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY h, o_orderkey) AS n FROM h),
e AS (SELECT greatest(1, 300 // greatest(1, count(*))) AS each FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders)),
p AS (SELECT r.*, CASE WHEN n <= each THEN 0 ELSE 1 END AS phase FROM r, e),
o AS (SELECT *, row_number() OVER (ORDER BY phase, CASE WHEN phase = 0 THEN o_orderpriority END NULLS FIRST, CASE WHEN phase = 0 THEN o_orderstatus END NULLS FIRST, h, o_orderkey) AS sample_rank FROM p)
SELECT o_orderkey, o_orderpriority, o_orderstatus, CAST(sample_rank AS INT) AS sample_rank FROM o WHERE sample_rank <= 300"""


@query(_STRATA_SQL)
def stratified_orders(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return stratified_sample(rows, ["o_orderpriority", "o_orderstatus"], 300, 42, "o_orderkey")


@query(f"SELECT id, label, description, {S.good_question(chr(39) + 'What is ' + chr(39) + ' || COALESCE(description, ' + chr(39) * 2 + ') || ' + chr(39) + '?' + chr(39), 'label')} AS good FROM labels")
def qa_quality_gate(spark, folder):
    asked = F.concat(F.lit("What is "), F.coalesce("description", F.lit("")), F.lit("?"))
    return table(spark, folder, "labels").select("id", "label", "description", X.good_question(asked, F.col("label")).alias("good"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY lower({S.squeeze('text')})")
def question_dedup(spark, folder):
    """Documents as questions, one of each wording: the first."""
    none = F.lit(None).cast("string")
    asked = table(spark, folder, "documents").filter(F.col("text").isNotNull()).select(
        F.lit("direct").alias("family"), F.lit(1).alias("snapshot_year"), F.lit("1").alias("anchor_date"), F.lit("timeless").alias("truth_type"), F.col("text").alias("question"), F.lit("a").alias("answer"), F.col("doc_id").alias("year"),
        *(none.alias(c) for c in ("pid", "subject_label", "subject_qid", "value_label", "value_qid")), "doc_id"
    )
    return G.unique_questions(asked).select("doc_id")


# Matching


@query(f"SELECT id, label, {S.normalize('label')} AS normal, {S.match_key('label')} AS key, {S.clean_prediction('description')} AS pred FROM labels")
def normalize_match(spark, folder):
    return table(spark, folder, "labels").select("id", "label", X.normalize("label").alias("normal"), X.match_key("label").alias("key"), X.clean_prediction("description").alias("pred"))


_PRED = "('Answer: ' || COALESCE(label, '') || ', ' || COALESCE(description, '') || ' (' || COALESCE(lang, '') || ') more')"


@query(
    f"""WITH p AS (SELECT id, lang, {_PRED} AS pred FROM labels), c AS (SELECT *, [{', '.join(S.candidate_parts('pred'))}] AS l FROM p), k AS (SELECT *, list_transform(l, lambda x: {S.match_key('x')}) AS ks FROM c)
SELECT id, lang, pred, array_to_string(list_filter(l, lambda x, i: ks[i] <> '' AND list_position(list_filter(ks, lambda y: y <> ''), ks[i]) = len(list_filter(ks[1:i], lambda y: y <> ''))), ' || ') AS cands FROM k"""
)
def candidate_answers(spark, folder):
    pred = F.concat(F.lit("Answer: "), F.coalesce("label", F.lit("")), F.lit(", "), F.coalesce("description", F.lit("")), F.lit(" ("), F.coalesce("lang", F.lit("")), F.lit(") more"))
    return table(spark, folder, "labels").select("id", "lang", pred.alias("pred")).withColumn("cands", F.array_join(X.candidates("pred"), " || "))


@query("WITH e AS (SELECT vec_id, label, embedding FROM embeddings) SELECT q.vec_id AS query_id, e.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(e.embedding[i] AS DOUBLE))), 6) AS cosine FROM e q JOIN e ON e.label = q.label WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id")
def semantic_match(spark, folder):
    """Cosine of each query vector (id divisible by 50) with all others of its label."""
    e = table(spark, folder, "embeddings")
    queries = e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("_l"), F.col("embedding").alias("_q"))
    met = e.join(queries, (F.col("label") == F.col("_l")) & (F.col("vec_id") != F.col("query_id")))
    return met.select("query_id", "vec_id", F.round(X.cosine("_q", "embedding"), 6).alias("cosine"))


# Evaluation of predictions against dialogues made of each customer's orders

_DIALOGUE_SQL = f"""turns AS (SELECT CAST(o_custkey AS VARCHAR) AS chain_id, ['carryover', 'scope_switch', 'multi_turn_chain'][o_custkey % 3 + 1] AS family, CAST(row_number() OVER w - 1 AS INT) AS turn_index, CAST(count(*) OVER (PARTITION BY o_custkey) AS INT) AS chain_length,
  'Which priority had order ' || o_orderkey || '?' AS question, o_orderpriority || ', state ' || o_orderstatus AS answer, last_value(o_orderpriority || ', state ' || o_orderstatus) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS present_day_answer
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
asked AS (SELECT *, turn_index = chain_length - 1 AS is_last, turn_index + 1 AS follow_pos, CASE (CAST(chain_id AS BIGINT) + turn_index) % 4 WHEN 0 THEN answer WHEN 1 THEN 'Answer: ' || upper(answer) WHEN 2 THEN present_day_answer ELSE 'zzz' END AS pred FROM turns WHERE chain_length >= 2),
scored AS (SELECT *, c1 AS correct1, NOT c1 AND {S.is_match('pred', 'present_day_answer')} AS drift1 FROM (SELECT *, {S.is_match('pred', 'answer')} AS c1 FROM asked))"""


def _dialogues(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    answer = F.concat("o_orderpriority", F.lit(", state "), "o_orderstatus")
    rows = table(spark, folder, "orders").select(
        "o_custkey", (F.row_number().over(w) - 1).alias("turn_index"), F.concat(F.lit("Which priority had order "), F.col("o_orderkey").cast("string"), F.lit("?")).alias("question"), answer.alias("answer")
    )
    family = F.array(*(F.lit(x) for x in ("carryover", "scope_switch", "multi_turn_chain")))[(F.col("o_custkey") % 3).cast("int")]
    turns = F.array_sort(F.collect_list(F.struct("turn_index", "question", "answer")))
    chains = rows.groupBy(F.col("o_custkey").cast("string").alias("chain_id"), family.alias("family")).agg(turns.alias("turns"))
    return chains.withColumn("present_day_answer", F.element_at("turns", -1)["answer"])


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    turns = E.explode_turns(_dialogues(spark, folder))
    case = (F.col("chain_id").cast("bigint") + F.col("turn_index")) % 4
    pred = F.when(case == 0, F.col("answer")).when(case == 1, F.concat(F.lit("Answer: "), F.upper("answer"))).when(case == 2, F.col("present_day_answer")).otherwise("zzz")
    return turns.withColumn("preds", F.array(pred))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return E.score(_asked(spark, folder))


@query(f"WITH {_DIALOGUE_SQL} SELECT chain_id, turn_index, pred, answer, {S.normalize('pred')} = {S.normalize('answer')} AS exact, correct1 AS relaxed FROM scored")
def match_exact_relaxed(spark, folder):
    return _scored(spark, folder).select("chain_id", "turn_index", "pred", "answer", X.match_exact("pred", "answer").alias("exact"), F.col("correct1").alias("relaxed"))


_WORDS = lambda x: f"CASE WHEN {S.match_key(x)} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({S.match_key(x)}, ' ') END"
_SHORT = lambda x: f"replace({S.match_key(x)}, ' ', '')"
_GRAMS = lambda x: f"CASE WHEN {_SHORT(x)} = '' THEN CAST([] AS VARCHAR[]) WHEN length({_SHORT(x)}) < 3 THEN [{_SHORT(x)}] ELSE list_transform(range(1, greatest(2, length({_SHORT(x)}) - 1)), lambda i: substr({_SHORT(x)}, i, 3)) END"
_OVER = lambda a, b: f"COALESCE(list_sum(list_transform(list_distinct({a}), lambda z: least(len(list_filter({a}, lambda y: y = z)), len(list_filter({b}, lambda y: y = z))))), 0)"
_LISTS_SQL = f"{_DIALOGUE_SQL}, lists AS (SELECT *, {_WORDS('pred')} AS tp, {_WORDS('answer')} AS tg, {_GRAMS('pred')} AS cp, {_GRAMS('answer')} AS cg FROM scored), counted AS (SELECT *, {_OVER('tp', 'tg')} AS tok_tp, len(tp) AS tok_pred, len(tg) AS tok_gold, {_OVER('cp', 'cg')} AS chr_tp, len(cp) AS chr_pred, len(cg) AS chr_gold FROM lists)"
_F1 = lambda c: f"round(CASE WHEN sum({c}_tp) = 0 THEN 0.0 ELSE 2.0 * (sum({c}_tp) / greatest(1, sum({c}_pred))) * (sum({c}_tp) / greatest(1, sum({c}_gold))) / (sum({c}_tp) / greatest(1, sum({c}_pred)) + sum({c}_tp) / greatest(1, sum({c}_gold))) END, 6)"


@query(f"WITH {_LISTS_SQL} SELECT family, CAST(sum(tok_tp) AS BIGINT) AS tp, CAST(sum(tok_pred) AS BIGINT) AS n_pred, CAST(sum(tok_gold) AS BIGINT) AS n_gold, {_F1('tok')} AS f1 FROM counted GROUP BY family")
def token_f1_micro(spark, folder):
    return _f1(spark, folder, "tok")


@query(f"WITH {_LISTS_SQL} SELECT family, CAST(sum(chr_tp) AS BIGINT) AS tp, CAST(sum(chr_pred) AS BIGINT) AS n_pred, CAST(sum(chr_gold) AS BIGINT) AS n_gold, {_F1('chr')} AS f1 FROM counted GROUP BY family")
def char3_f1_micro(spark, folder):
    return _f1(spark, folder, "chr")


def _f1(spark, folder, kind: str) -> DataFrame:
    sums = E.overlaps(_scored(spark, folder)).groupBy("family").agg(*(F.sum(F.col(f"{kind}_{a}").cast("bigint")).alias(b) for a, b in (("tp", "tp"), ("pred", "n_pred"), ("gold", "n_gold"))))
    return sums.withColumn("f1", E.micro_f1(F.col("tp"), F.col("n_pred"), F.col("n_gold")))


_R = lambda a, b: f"round(CAST(sum(CAST({a} AS INT)) AS DOUBLE) / greatest(1, {b}), 6)"


@query(
    f"""WITH {_LISTS_SQL} SELECT CASE grouping(family, chain_length, follow_pos) WHEN 7 THEN 'overall' WHEN 3 THEN 'family' WHEN 5 THEN 'chain_length' ELSE 'follow_pos' END AS "grouping",
  COALESCE(family, CAST(chain_length AS VARCHAR), CAST(follow_pos AS VARCHAR), 'all') AS bucket, count(*) AS n_turns, {_R('correct1', 'count(*)')} AS acc1, {_R('correct1', 'count(*)')} AS acck, {_R('drift1', 'count(*)')} AS drift1_rate, {_R('drift1', 'count(*)')} AS driftk_rate,
  {_R('drift1', 'count(*) - sum(CAST(correct1 AS INT))')} AS drift_of_errors, 1.0::DOUBLE AS present_rate, {_F1('tok')} AS token_f1, {_F1('chr')} AS char3_f1 FROM counted GROUP BY GROUPING SETS ((), (family), (chain_length), (follow_pos))"""
)
def metrics_by_group(spark, folder):
    return E.turn_metrics(E.overlaps(_scored(spark, folder)))


@query(
    f"""WITH {_DIALOGUE_SQL}, c AS (SELECT chain_id, family, chain_length, avg(CAST(correct1 AS INT)) AS m, min(CAST(correct1 AS INT)) AS s, max(CAST(is_last AND correct1 AS INT)) AS f FROM scored GROUP BY ALL)
SELECT CASE grouping(family, chain_length) WHEN 3 THEN 'overall' WHEN 1 THEN 'family' ELSE 'chain_length' END AS "grouping", COALESCE(family, CAST(chain_length AS VARCHAR), 'all') AS bucket, count(*) AS n_chains, round(avg(s), 6) AS strict_acc, round(avg(m), 6) AS mean_turn_acc, round(avg(f), 6) AS final_acc1, round(avg(f), 6) AS final_acck
FROM c GROUP BY GROUPING SETS ((), (family), (chain_length))"""
)
def chain_metrics(spark, folder):
    return E.chain_metrics(_scored(spark, folder))


_SAID = "(SELECT string_agg('User: ' || p.question || chr(10) || 'Assistant: ' || p.answer || chr(10), '' ORDER BY p.turn_index) FROM turns p WHERE p.chain_id = t.chain_id AND p.turn_index < t.turn_index)"


@query(f"WITH {_DIALOGUE_SQL} SELECT chain_id, turn_index, COALESCE({_SAID}, '') || 'User: ' || question || chr(10) || 'Assistant:' AS prompt FROM asked t")
def prompt_text(spark, folder):
    turns = E.context(E.explode_turns(_dialogues(spark, folder)))
    return turns.select("chain_id", "turn_index", E.prompt("messages").alias("prompt"))


@query(f"WITH {_DIALOGUE_SQL} SELECT t.chain_id, t.turn_index, CAST(t.turn_index + 1 AS INT) AS n_messages, t.turn_index = 0 AS alternates, md5(COALESCE((SELECT string_agg(p.question, chr(10) ORDER BY p.turn_index) || chr(10) FROM turns p WHERE p.chain_id = t.chain_id AND p.turn_index < t.turn_index), '') || t.question) AS digest FROM asked t")
def dialogue_context(spark, folder):
    """Context of earlier questions only."""
    turns = E.context(E.explode_turns(_dialogues(spark, folder)), with_answers=False)
    digest = F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "\n"))
    return turns.select("chain_id", "turn_index", F.size("messages").alias("n_messages"), E.alternates("messages").alias("alternates"), digest.alias("digest"))


@query(
    f"""WITH {_DIALOGUE_SQL}, r AS (SELECT chain_id, turn_index, pred, answer, CASE WHEN correct1 THEN 'correct' WHEN drift1 THEN 'drift' ELSE 'wrong_answer' END AS error_label, correct1, row_number() OVER (PARTITION BY correct1 ORDER BY chain_id, turn_index) AS n FROM scored)
SELECT chain_id, turn_index, pred, answer, error_label FROM r WHERE n <= CASE WHEN correct1 THEN 15 ELSE 60 END"""
)
def error_examples(spark, folder):
    return E.examples(_scored(spark, folder)).select("chain_id", "turn_index", "pred", "answer", "error_label")


# Three predictions a turn, turns without a present-day answer.

_TOP3_SQL = f"""{_DIALOGUE_SQL}, three AS (SELECT * REPLACE (CASE WHEN CAST(chain_id AS BIGINT) % 7 = 0 THEN NULL ELSE present_day_answer END AS present_day_answer, CASE WHEN (CAST(chain_id AS BIGINT) + turn_index) % 3 = 0 THEN 'yyy' ELSE pred END AS pred), CASE WHEN turn_index % 5 = 0 THEN answer ELSE 'www' END AS pred2, COALESCE(present_day_answer, '') AS pred3 FROM asked),
judged AS (SELECT *, COALESCE(present_day_answer, '') <> '' AS hp, {S.is_match('pred', 'answer')} AS c1, {S.is_match('pred2', 'answer')} OR {S.is_match('pred3', 'answer')} AS c23, {S.is_match('pred', "COALESCE(present_day_answer, '')")} AS p1, {S.is_match('pred2', "COALESCE(present_day_answer, '')")} OR {S.is_match('pred3', "COALESCE(present_day_answer, '')")} AS p23 FROM three),
top3 AS (SELECT *, c1 OR c23 AS ck, hp AND NOT c1 AND p1 AS d1, hp AND NOT (c1 OR c23) AND (p1 OR p23) AS dk FROM judged)"""


def _top3(spark: SparkSession, folder: str) -> DataFrame:
    turns = _asked(spark, folder)
    chain = F.col("chain_id").cast("bigint")
    first = F.when((chain + F.col("turn_index")) % 3 == 0, "yyy").otherwise(F.col("preds")[0])
    second = F.when(F.col("turn_index") % 5 == 0, F.col("answer")).otherwise("www")
    turns = turns.withColumn("preds", F.array(first, second, F.coalesce("present_day_answer", F.lit(""))))
    return E.score(turns.withColumn("present_day_answer", F.when(chain % 7 != 0, F.col("present_day_answer"))))


_SHARE = lambda a, b: f"round(CAST(sum(CAST({a} AS INT)) AS DOUBLE) / greatest(1, {b}), 6)"


@query(
    f"""WITH {_TOP3_SQL} SELECT family, count(*) AS n_turns, {_SHARE('c1', 'count(*)')} AS acc1, {_SHARE('ck', 'count(*)')} AS acck, {_SHARE('d1', 'sum(CAST(hp AS INT))')} AS drift1_rate, {_SHARE('dk', 'sum(CAST(hp AS INT))')} AS driftk_rate, {_SHARE('hp', 'count(*)')} AS present_rate FROM top3 GROUP BY family"""
)
def topk_metrics(spark, folder):
    found = E.turn_metrics(E.overlaps(_top3(spark, folder))).filter(F.col("grouping") == "family")
    return found.select(F.col("bucket").alias("family"), "n_turns", "acc1", "acck", "drift1_rate", "driftk_rate", "present_rate")


@query(f"WITH {_TOP3_SQL} SELECT CASE WHEN c1 THEN 'correct' WHEN d1 THEN 'drift' WHEN NOT hp THEN 'hallucination' ELSE 'wrong_answer' END AS error_label, count(*) AS n FROM top3 GROUP BY 1")
def error_labels(spark, folder):
    return _top3(spark, folder).groupBy("error_label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_DIALOGUE_SQL} SELECT chain_id, turn_index, follow_pos - 1 AS follow_pos, is_last FROM asked WHERE turn_index >= 1".replace("follow_pos - 1", "CAST(follow_pos - 1 AS INT)"))
def scope_turns(spark, folder):
    """Follow-up turns alone, their position counted from the first of them."""
    return E.explode_turns(_dialogues(spark, folder), scope_turns_only=True).select("chain_id", "turn_index", "follow_pos", "is_last")


@query(
    f"""WITH {_DIALOGUE_SQL} SELECT chain_id, family, CAST(count(*) AS INT) AS n_turns, bool_and({S.good_question('question', 'answer')}) AND count(DISTINCT lower({S.squeeze('question')})) = count(*) AND (count(*) < 3 OR count(DISTINCT lower({S.squeeze('answer')})) > 1) AS good FROM turns GROUP BY chain_id, family"""
)
def chain_quality_gate(spark, folder):
    """Chains of orders and whether they pass the gate (questions differ, answers are no placeholders)."""
    return _dialogues(spark, folder).select("chain_id", "family", F.size("turns").alias("n_turns"), X.good_chain("turns").alias("good"))


@query(f"WITH {_DIALOGUE_SQL} SELECT DISTINCT chain_id, family, chain_length AS n_turns, present_day_answer FROM turns")
def jsonl_roundtrip(spark, folder):
    """Chains written as JSON lines into the checkpoint folder and read again."""
    chains = _dialogues(spark, folder)
    path = f"{checkpoint_folder(spark)}/chains-{spark.sparkContext.applicationId}-{md5(folder.encode()).hexdigest()}"
    write_jsonl(chains, path)
    back = read_chains(spark, path, chains.schema)
    return back.select("chain_id", "family", F.size("turns").alias("n_turns"), "present_day_answer")


__all__ = ["QUERIES", "SQL", "rank_score", "sql_property"]
