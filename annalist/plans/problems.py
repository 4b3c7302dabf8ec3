"""Queries of the general data problems (p1 to p5 and p7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day_text, days_of, sql_days
from ..functions.ids import item_id, item_number, property_id, property_number, rank_name, sql_item, sql_property, sql_rank
from ..operators.hierarchy import descendants, hierarchy
from ..operators.history import build_history
from ..operators.intervals import date_terms, periods_and_gaps
from ..operators.references import orphan_references, parent_bitmaps
from ..operators.shredding import adjacency, claim_snaks, rejected_lines
from ..operators.snapshots import snapshot_changes, snapshot_list
from ..session import table

STATEMENT = ["s", "p", "v"]
TIMES = ["q_start_time", "q_end_time", "q_point_in_time"]


def statements(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """Claims with their keys as numbers ``s``, ``p``, ``v`` and the snapshot as ``y``."""
    return table(spark, folder, "claims").select(F.col("snapshot_year").alias("y"), item_number("subject_qid").alias("s"), property_number("pid").cast("int").alias("p"), item_number("value_qid").alias("v"), *extra)


def _named(df: DataFrame, *rest: str) -> list:
    names = (("s", item_id, "subject_qid"), ("p", property_id, "pid"), ("v", item_id, "value_qid"))
    return [f(c).alias(n) for c, f, n in names if c in df.columns] + list(rest)


# 1. History of changing attributes


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of a statement by whether it is held (has a row that is not deprecated); those that are."""
    held = F.max(rank_name("rank") != "deprecated")
    versions = build_history(statements(spark, folder, "rank"), STATEMENT, "y", {"held": held}).filter("held")
    return versions.select(*_named(versions, "valid_from", "valid_to"))


def p1_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of a statement by its trust: a change of the highest rank it has in a snapshot closes one and opens another."""
    trust = F.when(rank_name("rank") == "preferred", 2).when(rank_name("rank") == "deprecated", 0).otherwise(1)
    versions = build_history(statements(spark, folder, "rank"), STATEMENT, "y", {"trust": F.max(trust)})
    return versions.select(*_named(versions, "trust", "valid_from", "valid_to"))


_STATEMENTS_SQL = f"SELECT snapshot_year AS y, {sql_item('subject_qid')} AS s, {sql_property('pid')} AS p, {sql_item('value_qid')} AS v, {sql_rank('rank')} AS rank, * EXCLUDE (snapshot_year, subject_qid, pid, value_qid, rank) FROM claims"
_OUT_SQL = "'Q' || s AS subject_qid, 'P' || p AS pid, 'Q' || v AS value_qid"

P1_FOUND_SQL = f"""
WITH k AS (SELECT DISTINCT s, p, v, y FROM ({_STATEMENTS_SQL}) WHERE s IS NOT NULL AND p IS NOT NULL AND v IS NOT NULL AND rank <> 'deprecated'),
g AS (SELECT *, y - row_number() OVER (PARTITION BY s, p, v ORDER BY y) AS island FROM k)
SELECT {_OUT_SQL}, CAST(min(y) AS INT) AS valid_from, CAST(max(y) AS INT) AS valid_to FROM g GROUP BY s, p, v, island"""

P1_VERSIONS_SQL = f"""
WITH k AS (SELECT s, p, v, y, max(CASE rank WHEN 'preferred' THEN 2 WHEN 'deprecated' THEN 0 ELSE 1 END) AS trust FROM ({_STATEMENTS_SQL})
  WHERE s IS NOT NULL AND p IS NOT NULL AND v IS NOT NULL GROUP BY s, p, v, y),
g AS (SELECT *, y - row_number() OVER (PARTITION BY s, p, v, trust ORDER BY y) AS island FROM k)
SELECT {_OUT_SQL}, CAST(trust AS INT) AS trust, CAST(min(y) AS INT) AS valid_from, CAST(max(y) AS INT) AS valid_to FROM g GROUP BY s, p, v, trust, island"""


# 2. Overlapping and gapped intervals


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    facts = table(spark, folder, "temporal_facts").select(item_number("subject_qid").alias("s"), property_number("pid").cast("int").alias("p"), "start_date", "end_date", "pit_date")
    found = periods_and_gaps(date_terms(facts, "start_date", "end_date", "pit_date"), ["s", "p"], "_first", "_last")
    return found.select(*_named(found), "kind", day_text("from_unit").alias("from_day"), day_text("to_unit").alias("to_day"))


P2_FOUND_SQL = f"""
WITH t AS (SELECT DISTINCT {sql_item('subject_qid')} AS s, {sql_property('pid')} AS p, COALESCE(start_date, DATE '0001-01-01') AS a, COALESCE(end_date, DATE '9999-12-31') AS b
  FROM temporal_facts WHERE pit_date IS NULL AND (start_date IS NOT NULL OR end_date IS NOT NULL)),
u AS (SELECT * FROM t WHERE s IS NOT NULL AND p IS NOT NULL AND a <= b),
w AS (SELECT *, max(b) OVER (PARTITION BY s, p ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY s, p ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM w),
m AS (SELECT s, p, island, min(a) AS a, max(b) AS b FROM i GROUP BY s, p, island),
n AS (SELECT *, lead(a) OVER (PARTITION BY s, p ORDER BY a) AS next FROM m)
SELECT 'Q' || s AS subject_qid, 'P' || p AS pid, 'period' AS kind, strftime(a, '%Y-%m-%d') AS from_day, strftime(b, '%Y-%m-%d') AS to_day FROM n
UNION ALL SELECT 'Q' || s, 'P' || p, 'gap', strftime(b + 1, '%Y-%m-%d'), strftime(next - 1, '%Y-%m-%d') FROM n WHERE next IS NOT NULL"""


# 3. References to records that do not exist


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    sources = {n: table(spark, folder, n).select("snapshot_year", item_number("value_qid").alias("code")) for n in ("claims", "temporal_facts")}
    periods = sorted({y for d in sources.values() for y in snapshot_list(d, "snapshot_year")})
    labels = table(spark, folder, "labels").select(item_number("id").alias("code"), "created_at", "deleted_at")
    parents = parent_bitmaps(labels, "code", "created_at", "deleted_at", periods, instant=lambda y: F.make_date(y, F.lit(1), F.lit(1)).cast("timestamp_ntz"))
    orphans = orphan_references(sources, parents, "snapshot_year", "code", periods)
    return orphans.select(F.col("source").alias("table_name"), F.col("period").alias("snapshot_year"), item_id("code").alias("value_qid"), "kind")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Number of orphan references by table, snapshot year and kind."""
    return p3_found(spark, folder).groupBy("table_name", "snapshot_year", "kind").agg(F.count(F.lit(1)).alias("n_items"))


P3_FOUND_SQL = f"""
WITH r AS (SELECT DISTINCT 'claims' AS table_name, snapshot_year, {sql_item('value_qid')} AS code FROM claims
  UNION ALL SELECT DISTINCT 'temporal_facts', snapshot_year, {sql_item('value_qid')} FROM temporal_facts),
l AS (SELECT {sql_item('id')} AS code, created_at, deleted_at FROM labels),
t AS (SELECT r.table_name, r.snapshot_year, r.code, count(l.code) AS known, count(*) FILTER (WHERE l.code IS NOT NULL AND (created_at IS NULL OR created_at <= make_timestamp(r.snapshot_year, 1, 1, 0, 0, 0))) AS begun,
  count(*) FILTER (WHERE l.code IS NOT NULL AND (created_at IS NULL OR created_at <= make_timestamp(r.snapshot_year, 1, 1, 0, 0, 0)) AND (deleted_at IS NULL OR deleted_at > make_timestamp(r.snapshot_year, 1, 1, 0, 0, 0))) AS live
  FROM r LEFT JOIN l ON l.code = r.code WHERE r.code IS NOT NULL AND r.snapshot_year IS NOT NULL GROUP BY ALL)
SELECT table_name, snapshot_year, 'Q' || code AS value_qid, CASE WHEN known = 0 THEN 'missing' WHEN begun = 0 THEN 'later' ELSE 'deleted' END AS kind FROM t WHERE live = 0"""
P3_REPORT_SQL = f"SELECT table_name, snapshot_year, kind, count(*) AS n_items FROM ({P3_FOUND_SQL}) GROUP BY ALL"


# 4. Deeply nested records


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return claim_snaks(table(spark, folder, "entity_docs"), "row_no", "line")


_snak_text = lambda x, path: f"CASE WHEN json_type({x} -> '{path}') IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') THEN json_extract_string({x}, '{path}') END"


def _snak_sql(x: str) -> str:
    at = lambda k: _snak_text(x, f"$.datavalue.value.{k}")
    item = f"COALESCE(CASE WHEN regexp_full_match({at('numeric-id')}, '[0-9]+') THEN 'Q' || {at('numeric-id')} END, 'Q' || TRY_CAST(regexp_extract({at('id')}, '^\\s*[Qq]([0-9]+)\\s*$', 1) AS HUGEINT), '')"
    return f"""CASE WHEN COALESCE({_snak_text(x, '$.snaktype')}, 'value') <> 'value' THEN '' WHEN json_type({x} -> '$.datavalue.value') = 'VARCHAR' THEN json_extract_string({x}, '$.datavalue.value')
  WHEN {at('entity-type')} = 'item' OR {at('entity-type')} IS NULL AND COALESCE({at('numeric-id')}, {at('id')}) IS NOT NULL THEN {item} ELSE COALESCE({at('time')}, {at('amount')}, {at('text')}, '') END"""


_pid_sql = lambda p: f"COALESCE('P' || TRY_CAST(regexp_extract({p}, '^\\s*[Pp]([0-9]+)\\s*$', 1) AS BIGINT), {p})"
P4_FOUND_SQL = f"""
WITH r AS (SELECT row_no, regexp_replace(regexp_replace(line, '^[ \\t\\r\\n\\x{{FEFF}}\\x00]+|[ \\t\\r\\n\\x{{FEFF}}\\x00]+$', '', 'g'), ',$', '') AS t FROM entity_docs WHERE line IS NOT NULL),
d AS (SELECT row_no, CASE WHEN json_valid(t) THEN t END AS t FROM r),
docs AS (SELECT row_no, t -> '$.claims' AS claims FROM d WHERE json_type(t) = 'OBJECT' AND json_type(t -> '$.id') = 'VARCHAR' AND starts_with(t ->> '$.id', 'Q') AND json_type(t -> '$.claims') = 'OBJECT'),
k AS (SELECT row_no, pid, claims -> pid AS list FROM (SELECT *, unnest(json_keys(claims)) AS pid FROM docs)),
c AS (SELECT row_no, pid, claim_no, claim FROM (SELECT row_no, pid, unnest(range(CAST(json_array_length(list) AS BIGINT))) AS claim_no, unnest(from_json(list, '["JSON"]')) AS claim FROM k WHERE json_type(list) = 'ARRAY') WHERE json_type(claim) = 'OBJECT'),
q AS (SELECT *, quals -> qual_pid AS list FROM (SELECT row_no, pid, claim_no, claim -> '$.qualifiers' AS quals, unnest(json_keys(claim -> '$.qualifiers')) AS qual_pid FROM c WHERE json_type(claim -> '$.qualifiers') = 'OBJECT')),
s AS (SELECT * FROM (SELECT row_no, pid, claim_no, qual_pid, unnest(range(CAST(json_array_length(list) AS BIGINT))) AS qual_no, unnest(from_json(list, '["JSON"]')) AS snak FROM q WHERE json_type(list) = 'ARRAY') WHERE json_type(snak) = 'OBJECT')
SELECT row_no, {_pid_sql('pid')} AS pid, CAST(claim_no AS INT) AS claim_no, '' AS qual_pid, CAST(-1 AS INT) AS qual_no, CASE WHEN json_type(claim -> '$.mainsnak') = 'OBJECT' THEN {_snak_sql("(claim -> '$.mainsnak')")} ELSE '' END AS snak_value FROM c
UNION ALL SELECT row_no, {_pid_sql('pid')}, CAST(claim_no AS INT), {_pid_sql('qual_pid')}, CAST(qual_no AS INT), {_snak_sql('snak')} FROM s"""


def p4_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The adjacency table of all lines."""
    return adjacency(table(spark, folder, "entity_docs"), "row_no", "line")


def p4_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that give no rows, by reason."""
    return rejected_lines(table(spark, folder, "entity_docs"), "line")


# 5. What changed between full snapshots


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = statements(spark, folder, "rank", *TIMES)
    changes = snapshot_changes(rows, STATEMENT, "y", [rank_name("rank"), *(days_of(c) for c in TIMES)])
    return changes.select(F.col("y").alias("snapshot_year"), *_named(changes, "change"))


P5_FOUND_SQL = f"""
WITH c AS (SELECT DISTINCT s, p, v, y, rank, {', '.join(f'CAST({sql_days(t)} AS VARCHAR) AS t{i}' for i, t in enumerate(TIMES))} FROM ({_STATEMENTS_SQL}) WHERE s IS NOT NULL AND p IS NOT NULL AND v IS NOT NULL AND y IS NOT NULL),
h AS (SELECT s, p, v, y, string_agg(rank || '|' || t0 || '|' || t1 || '|' || t2, ';' ORDER BY rank, t0, t1, t2) AS state FROM c GROUP BY s, p, v, y),
e AS (SELECT min(snapshot_year) AS lo, max(snapshot_year) AS hi FROM claims),
j AS (SELECT COALESCE(a.y, b.y + 1) AS y, COALESCE(a.s, b.s) AS s, COALESCE(a.p, b.p) AS p, COALESCE(a.v, b.v) AS v,
  CASE WHEN b.y IS NULL THEN 'added' WHEN a.y IS NULL THEN 'removed' WHEN a.state <> b.state THEN 'changed' END AS change
  FROM h a FULL OUTER JOIN h b ON a.s = b.s AND a.p = b.p AND a.v = b.v AND a.y = b.y + 1)
SELECT y AS snapshot_year, {_OUT_SQL}, change FROM j, e WHERE change IS NOT NULL AND y > lo AND y <= hi"""


# 7. Parent-child links


def _links(spark: SparkSession, folder: str) -> DataFrame:
    rows = statements(spark, folder, "rank").filter((F.col("y") == 2025) & F.col("p").isin(131, 279, 361) & (rank_name("rank") != "deprecated"))
    return rows.select("p", "s", "v")


_TREE_CODES = 1000  # a tree of p7_hierarchies is year times this plus the number of the property


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    paths = hierarchy(_links(spark, folder), "p", "s", "v")
    text = F.array_join(F.transform("path", item_id), "/")
    return paths.select(property_id("tree").alias("pid"), item_id("node").alias("node_qid"), F.coalesce(item_id("root"), F.lit("")).alias("root_qid"), "depth", F.coalesce(text, F.lit("")).alias("path"))


def p7_hierarchies(spark: SparkSession, folder: str) -> DataFrame:
    """The hierarchies of every snapshot, each pid of each snapshot a tree of its own: root and depth of each node."""
    rows = statements(spark, folder, "rank").filter(F.col("p").isin(131, 279, 361) & (rank_name("rank") != "deprecated"))
    trees = rows.select((F.col("y").cast("bigint") * _TREE_CODES + F.col("p")).alias("t"), "s", "v")
    paths = hierarchy(trees, "t", "s", "v")
    year, pid = F.floor(F.col("tree") / _TREE_CODES).cast("int"), F.pmod(F.col("tree"), F.lit(_TREE_CODES))
    return paths.select(year.alias("snapshot_year"), property_id(pid).alias("pid"), item_id("node").alias("node_qid"), F.coalesce(item_id("root"), F.lit("")).alias("root_qid"), "depth")


def p7_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All descendants of each node with their distance."""
    pairs = descendants(hierarchy(_links(spark, folder), "p", "s", "v"))
    return pairs.select(property_id("tree").alias("pid"), item_id("node").alias("node_qid"), item_id("descendant").alias("descendant_qid"), "distance")


_TREE_SQL = f"""
WITH RECURSIVE l AS (SELECT p, s, v FROM ({_STATEMENTS_SQL}) WHERE y = 2025 AND p IN (131, 279, 361) AND rank <> 'deprecated' AND s IS NOT NULL AND v IS NOT NULL),
e AS (SELECT p, s, min(v) AS v FROM l GROUP BY p, s), n AS (SELECT p, s AS node FROM l UNION SELECT p, v FROM l),
t AS (SELECT p, node, node AS root, 0 AS depth, 'Q' || node AS path FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.p = n.p AND e.s = n.node)
  UNION ALL SELECT e.p, e.s, t.root, t.depth + 1, t.path || '/Q' || e.s FROM t JOIN e ON e.p = t.p AND e.v = t.node)"""
_TREES_SQL = f"""
WITH RECURSIVE l AS (SELECT y, p, s, v FROM ({_STATEMENTS_SQL}) WHERE y IS NOT NULL AND p IN (131, 279, 361) AND rank <> 'deprecated' AND s IS NOT NULL AND v IS NOT NULL),
e AS (SELECT y, p, s, min(v) AS v FROM l GROUP BY y, p, s), n AS (SELECT y, p, s AS node FROM l UNION SELECT y, p, v FROM l),
t AS (SELECT y, p, node, node AS root, 0 AS depth FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.y = n.y AND e.p = n.p AND e.s = n.node)
  UNION ALL SELECT e.y, e.p, e.s, t.root, t.depth + 1 FROM t JOIN e ON e.y = t.y AND e.p = t.p AND e.v = t.node)"""
P7_HIERARCHIES_SQL = f"""{_TREES_SQL}
SELECT n.y AS snapshot_year, 'P' || n.p AS pid, 'Q' || n.node AS node_qid, COALESCE('Q' || t.root, '') AS root_qid, CAST(COALESCE(t.depth, -1) AS INT) AS depth FROM n LEFT JOIN t ON t.y = n.y AND t.p = n.p AND t.node = n.node"""
P7_FOUND_SQL = f"""{_TREE_SQL}
SELECT 'P' || n.p AS pid, 'Q' || n.node AS node_qid, COALESCE('Q' || t.root, '') AS root_qid, CAST(COALESCE(t.depth, -1) AS INT) AS depth, COALESCE(t.path, '') AS path FROM n LEFT JOIN t ON t.p = n.p AND t.node = n.node"""
P7_DESCENDANTS_SQL = f"""{_TREE_SQL},
u AS (SELECT p, node, node AS up, 0 AS distance FROM t UNION ALL SELECT u.p, u.node, e.v, u.distance + 1 FROM u JOIN e ON e.p = u.p AND e.s = u.up)
SELECT 'P' || p AS pid, 'Q' || up AS node_qid, 'Q' || node AS descendant_qid, CAST(distance AS INT) AS distance FROM u WHERE distance > 0"""


QUERIES = {f.__name__: f for f in (p1_found, p1_versions, p2_found, p3_found, p3_report, p4_found, p4_nodes, p4_rejected, p5_found, p7_found, p7_hierarchies, p7_descendants)}
SQL = {"p1_found": P1_FOUND_SQL, "p1_versions": P1_VERSIONS_SQL, "p2_found": P2_FOUND_SQL, "p3_found": P3_FOUND_SQL, "p3_report": P3_REPORT_SQL, "p4_found": P4_FOUND_SQL, "p5_found": P5_FOUND_SQL, "p7_found": P7_FOUND_SQL, "p7_hierarchies": P7_HIERARCHIES_SQL, "p7_descendants": P7_DESCENDANTS_SQL}
