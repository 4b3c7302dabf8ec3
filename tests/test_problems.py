"""The general data problems against plain Python on small and on random input, and their edge cases."""

import datetime as dt
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from annalist.operators import hierarchy, history, intervals, references, shredding, snapshots
from annalist.plans import problems


def statements(n, seed, years=range(2018, 2026)):
    rnd = random.Random(seed)
    return [(rnd.choice([None, *range(1, 5)]) if rnd.random() < 0.1 else rnd.randrange(1, 5), rnd.randrange(1, 3), rnd.randrange(1, 4), rnd.choice(list(years)), rnd.choice("abc"), "extra") for _ in range(n)]


SCHEMA = "s bigint, p int, v bigint, y int, a string, _at string"


def plain_history(rows, attribute):
    state = {}
    for s, p, v, y, a, _ in rows:
        if s is not None:
            state.setdefault((s, p, v), {}).setdefault(y, set()).add(a if attribute else "")
    out = []
    for k, by in state.items():
        run = None
        for y in sorted(by):
            x = next(iter(by[y])) if len(by[y]) == 1 else None
            if run and run[1] == y - 1 and run[2] == x:
                run[1] = y
            else:
                if run:
                    out.append((*k, *( [run[2]] if attribute else []), run[0], run[1]))
                run = [y, y, x]
        out.append((*k, *([run[2]] if attribute else []), run[0], run[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_history_runs(spark, rows, seed):
    data = statements(120, seed)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert rows(history.build_history(df, ["s", "p", "v"], "y")) == plain_history(data, False)


def test_history_attributes_and_merge(spark, rows):
    data = list({(s, p, v, y): (s, p, v, y, a, x) for s, p, v, y, a, x in statements(150, 3)}.values())
    df = spark.createDataFrame(data, SCHEMA)
    built = rows(history.build_history(df, ["s", "p", "v"], "y", ["a"]))
    assert built == plain_history(data, True)
    versions = None
    for y in range(2018, 2026):
        versions = history.merge_snapshots(df.filter(F.col("y") == y), ["s", "p", "v"], "y", ["a"], list(range(2018, y + 1)), versions)
        versions = spark.createDataFrame(versions.collect(), versions.schema)
    assert rows(versions.select("s", "p", "v", "a", "valid_from", "valid_to")) == built


def test_history_over_a_year_without_snapshot(spark, rows):
    df = spark.createDataFrame([(1, 2018, "a"), (1, 2020, "a"), (1, 2021, "b"), (2, 2018, None), (2, 2021, None), (None, 2018, "x")], "s bigint, y int, a string")
    assert rows(history.build_history(df, ["s"], "y", ["a"])) == [(1, "a", 2018, 2020), (1, "b", 2021, 2021), (2, None, 2018, 2018), (2, None, 2021, 2021)]


def test_history_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert history.build_history(df, ["s"], "y").count() == 0


def test_snapshot_changes(spark, rows):
    data = statements(200, 4, range(2018, 2022))
    df = spark.createDataFrame(data, SCHEMA)
    state = {}
    for s, p, v, y, a, _ in data:
        if s is not None:
            state.setdefault((s, p, v), {}).setdefault(y, set()).add(a)
    want = []
    for k, by in state.items():
        for y in range(2019, 2022):
            was, now = by.get(y - 1), by.get(y)
            change = "added" if now and not was else "removed" if was and not now else "changed" if was and was != now else None
            if change:
                want.append((y, *k, change))
    assert rows(snapshots.snapshot_changes(df, ["s", "p", "v"], "y", [F.col("a")])) == sorted(want, key=str)
    assert snapshots.snapshot_changes(df.limit(0), ["s"], "y", [F.col("a")]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 126, 127, 128, 200])
def test_changes_between_many_snapshots(spark, rows, n):
    rnd, years = random.Random(n), [1000 + 3 * i for i in range(n)]
    data = [(k, y, rnd.choice("abb")) for k in range(12) for y in years if rnd.random() < 0.7 for _ in range(rnd.choice([1, 1, 3]))] + [(99, y, "z") for y in (years[0], years[-1])]
    state = {}
    for k, y, a in data:
        state.setdefault((k, y), set()).add(a)
    want = []
    for k in {k for k, _, _ in data}:
        for b, y in zip(years, years[1:]):
            was, now = state.get((k, b)), state.get((k, y))
            if was != now:
                want.append((y, k, "added" if not was else "removed" if not now else "changed"))
    df = spark.createDataFrame(data, "s bigint, y int, a string")
    assert rows(snapshots.snapshot_changes(df, ["s"], "y", [F.col("a")])) == sorted(want, key=str)


def test_changes_over_a_year_without_snapshot(spark, rows):
    df = spark.createDataFrame([(1, 2018, "a"), (1, 2020, "a"), (2, 2018, "a"), (2, 2020, "b"), (3, 2018, "a"), (4, 2020, None)], "s bigint, y int, a string")
    assert rows(snapshots.snapshot_changes(df, ["s"], "y", [F.col("a")])) == [(2020, 2, "changed"), (2020, 3, "removed"), (2020, 4, "added")]


@pytest.mark.parametrize("seed,span", [(1, 300), (2, 20_000), (3, 3_652_058)])
def test_periods_and_gaps(spark, rows, seed, span):
    rnd = random.Random(seed)
    data = []
    for _ in range(60):
        a = rnd.randrange(span)
        data.append((rnd.randrange(3), a, min(span, a + rnd.choice([0, 1, 5, 63, 64, 65, 500, 4096, 300_000])), "x"))
    data += [(0, 5, 4, "reversed"), (None, 1, 2, "null key"), (1, None, 2, "null start"), data[0]]
    df = spark.createDataFrame(data, "k int, a int, b int, word string").repartition(3)
    want = []
    for k in range(3):
        terms, merged = sorted((a, b) for x, a, b, _ in data if x == k and a is not None and a <= b), []
        for a, b in terms:
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want += [(k, "period", a, b) for a, b in merged] + [(k, "gap", x[1] + 1, y[0] - 1) for x, y in zip(merged, merged[1:])]
    assert rows(intervals.periods_and_gaps(df, ["k"], "a", "b")) == sorted(want, key=str)
    assert intervals.periods_and_gaps(df.limit(0), ["k"], "a", "b").count() == 0


def test_open_terms(spark, rows):
    day = dt.date
    df = spark.createDataFrame([(1, None, day(2000, 1, 1), None), (1, day(2001, 1, 1), None, None), (1, None, None, None), (1, day(1, 1, 1), None, day(2000, 5, 5))], "k int, s date, e date, p date")
    found = intervals.periods_and_gaps(intervals.date_terms(df, "s", "e", "p"), ["k"], "_first", "_last")
    text = found.select("kind", problems.day_text("from_unit"), problems.day_text("to_unit"))
    assert rows(text) == [("gap", "2000-01-02", "2000-12-31"), ("period", "0001-01-01", "2000-01-01"), ("period", "2001-01-01", "9999-12-31")]


def test_orphans(spark, rows):
    rnd = random.Random(5)
    refs = [("t", y, rnd.choice([None, rnd.randrange(300)])) for y in (2018, 2019) for _ in range(200)]
    at = lambda y, m: dt.datetime(y, m, 1)
    parents = [(rnd.randrange(250), at(2017, 5) if rnd.random() < 0.6 else at(2018, 6), None if rnd.random() < 0.5 else at(2018, 1) if rnd.random() < 0.5 else at(2018, 9), "code") for _ in range(260)]
    r = {"t": spark.createDataFrame([x[1:] for x in refs], "y int, code bigint")}
    p = references.parent_bitmaps(spark.createDataFrame(parents, "code bigint, a timestamp_ntz, b timestamp_ntz, _range string"), "code", "a", "b", [2018, 2019], lambda y: F.make_date(y, F.lit(1), F.lit(1)).cast("timestamp_ntz"))
    want = set()
    for _, y, c in refs:
        own, now = [x for x in parents if x[0] == c], dt.datetime(y, 1, 1)
        if c is not None and not any(a <= now and (b is None or b > now) for _, a, b, _ in own):
            want.add(("t", y, c, "missing" if not own else "later" if all(a > now for _, a, _, _ in own) else "deleted"))
    assert rows(references.orphan_references(r, p, "y", "code", [2018, 2019])) == sorted(want, key=str)
    assert {x.kind for x in references.orphan_references(r, p.limit(0), "y", "code", [2018, 2019]).collect()} == {"missing"}
    assert references.orphan_references({"t": r["t"].limit(0)}, p, "y", "code", []).count() == 0


def test_orphans_of_many_periods_and_sources(spark, rows):
    rnd, years = random.Random(8), [1500 + 2 * i for i in range(140)]
    at = lambda y: dt.datetime(y, 1, 1)
    refs = {n: [(rnd.choice(years), rnd.randrange(40)) for _ in range(400)] + [(None, 1), (1500, None)] for n in "ab"}
    parents = [(rnd.randrange(35), None if rnd.random() < 0.2 else at(rnd.randrange(1490, 1790)), None if rnd.random() < 0.4 else at(rnd.randrange(1490, 1790))) for _ in range(60)]
    dfs = {n: spark.createDataFrame(v, "y int, code bigint") for n, v in refs.items()}
    p = references.parent_bitmaps(spark.createDataFrame(parents, "code bigint, a timestamp_ntz, b timestamp_ntz"), "code", "a", "b", years, lambda y: F.make_date(y, F.lit(1), F.lit(1)).cast("timestamp_ntz"))
    want = set()
    for n, v in refs.items():
        for y, c in v:
            own = [x for x in parents if x[0] == c]
            if None not in (y, c) and not any((a is None or a <= at(y)) and (b is None or b > at(y)) for _, a, b in own):
                want.add((n, y, c, "missing" if not own else "later" if all(a is not None and a > at(y) for _, a, _ in own) else "deleted"))
    assert rows(references.orphan_references(dfs, p, "y", "code", years)) == sorted(want, key=str)


def test_encode_keys(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", None, "c", "a"]], "k string").repartition(3)
    got = {r[0]: r[1] for r in references.encode_keys(df, "k").collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize("local", [hierarchy.LOCAL, 200, 60, 12])
def test_hierarchy(spark, rows, local):
    """Whole trees in a partition, tops that fit one, and tops that need rounds of joins."""
    rnd = random.Random(6)
    links = [(1, n, rnd.randrange(max(1, n - 3), n)) for n in range(2, 120)] + [(2, i, i + 1) for i in range(1, 40)]
    links += [(3, 1, 2), (3, 2, 3), (3, 3, 1), (3, 9, 2), (3, 10, 9), (3, 20, 20), (3, 21, 20), (3, None, 5), (3, 5, None), (3, 1, 2)]
    links += [(4, i, 0) for i in range(1, 300)]
    df = spark.createDataFrame(links, "t int, n bigint, up bigint").repartition(7)
    parent = {(t, n): u for t, n, u in links if n is not None and u is not None}
    want = []
    for t, n in {(t, x) for t, n, u in links for x in (n, u) if None not in (n, u)}:
        path = [n]
        while (t, path[-1]) in parent and len(path) < 500:
            path.append(parent[(t, path[-1])])
        want.append((t, n, None, -1, None) if len(path) == 500 else (t, n, path[-1], len(path) - 1, tuple(path[::-1])))
    got = hierarchy.hierarchy(df, "t", "n", "up", local)
    assert rows(got) == sorted(want, key=str)
    pairs = {(t, a, p[-1], len(p) - 1 - i) for t, n, _, d, p in want if d > 0 for i, a in enumerate(p[:-1])}
    assert set(rows(hierarchy.descendants(got))) == pairs
    assert hierarchy.hierarchy(df.limit(0), "t", "n", "up").count() == 0


def test_most_nodes_leave_their_partition_with_more_than_one_link(spark):
    rnd = random.Random(9)
    links = [(1, n, rnd.randrange(max(1, n - 40), n)) for n in range(2, 6400)]
    edges = spark.createDataFrame(links, "tree bigint, node bigint, parent bigint").withColumn("steps", F.array("node"))
    cut, whole = hierarchy.local_forests(edges, 100)
    assert not whole and cut.rdd.getNumPartitions() == 64
    assert cut.filter(F.size("path") > 1).count() > 0.5 * len(links)
    assert hierarchy.local_forests(edges)[0].filter(F.size("path") > 1).count() > 0.9 * len(links)


LINES = [
    None, "", "  ", "[", "]", "{bad", '{"id":"P31","claims":{"P1":[{}]}}', '{"id":"Q1","claims":[]}', "null", '"Q12"', "[]",
    '﻿{"id":"Q2","claims":{"P39":[{"mainsnak":{"snaktype":"value","datavalue":{"value":{"entity-type":"item","id":"Q007"}}},"qualifiers":{"P580":[{"snaktype":"novalue"},{"snaktype":"value","datavalue":{"value":{"time":"+2001-00-00T00:00:00Z"}}}],"P1545":[{"snaktype":"value","datavalue":{"value":"3a"}}]}},{}],"P31":null}} ,\r',
    '{"id":"Q3","claims":{"P1448":[{"mainsnak":{"snaktype":"value","datavalue":{"value":{"text":"Ø","language":"da"}}},"qualifiers":[]}],"P1082":[{"mainsnak":{"snaktype":"value","datavalue":{"value":{"amount":"+5","unit":"1"}}},"references":[{"snaks":{}}]}]}}',
]


def test_claim_snaks(spark, rows):
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(LINES)], "row_no bigint, line string, pid int")
    assert rows(shredding.claim_snaks(df, "row_no", "line")) == sorted(
        [(11, "P39", 0, "", -1, "Q7"), (11, "P39", 0, "P580", 0, ""), (11, "P39", 0, "P580", 1, "+2001-00-00T00:00:00Z"), (11, "P39", 0, "P1545", 0, "3a"), (11, "P39", 1, "", -1, ""), (12, "P1448", 0, "", -1, "Ø"), (12, "P1082", 0, "", -1, "+5")], key=str
    )
    assert shredding.claim_snaks(df.limit(0), "row_no", "line").count() == 0


@pytest.mark.parametrize("text", ['{"a":[1,{"b":null},[]],"c":"x\\u00e9"}', "[]", "{}", ' [ 1 , -2.5e3 , true , false , null ] ', '"x"', "7", '[[["a"]],{"k":{"l":[{}]}}]', '{"a":1,"a":2}', "[1,]", "[1", '{"a"}', '{"a":}', "{,}", "1 2", "", "[01]", "{]", '["a" "b"]', "nul", '{1:2}'])
def test_nested_parser_reads_what_json_reads(text):
    plain = lambda x: {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else float(x) if type(x) in (shredding.Number, int) else x
    try:
        want = plain(json.loads(text))
    except ValueError:
        with pytest.raises(ValueError):
            shredding.parse_nested(text)
    else:
        assert plain(shredding.parse_nested(text)) == want


def test_very_deep_lines_and_long_numbers_are_kept(spark, rows):
    deep = '{"id":"Q5","claims":{"P1":[{"mainsnak":{"snaktype":"value","datavalue":{"value":"x"}},"more":' + "[" * 100_000 + "]" * 100_000 + "}]}}"
    long = '{"id":"Q6","claims":{"P2":[{"mainsnak":{"snaktype":"value","datavalue":{"value":{"amount":"+1","n":' + "9" * 6000 + "}}}}]}}"
    half = '{"id":"Q7","claims":{"P3":[{"mainsnak":{"snaktype":"value","datavalue":{"value":"a\\ud800b"}}}]}}'
    df = spark.createDataFrame([(0, deep), (1, long), (2, half), (3, None), (4, "["), (5, "{"), (6, '"x"'), (7, " ")], "row_no bigint, line string")
    assert rows(shredding.claim_snaks(df, "row_no", "line")) == [(0, "P1", 0, "", -1, "x"), (1, "P2", 0, "", -1, "+1"), (2, "P3", 0, "", -1, "a\ufffdb")]
    nodes = shredding.adjacency(df, "row_no", "line").groupBy("row_no").count()
    assert rows(nodes)[0] == (0, 100_009)
    assert rows(shredding.rejected_lines(df, "line")) == [("blank", 1), ("bracket of a dump", 1), ("no JSON", 1), ("no record", 1), ("null line", 1)]


def test_adjacency_round_trip(spark):
    docs = [{"a": [1, {"b": None}, []], "c": {"d": "x", "e": True}, "": 1.5}, [], {}, [[["deep"]]]]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "k bigint, line string")
    by = {}
    for r in shredding.adjacency(df, "k", "line").orderBy("k", "node").collect():
        by.setdefault(r.k, []).append(r)

    def build(nodes, n):
        own = sorted((x for x in nodes if x.parent == n.node), key=lambda x: x.ordinal)
        if n.kind == "object":
            return {x.label: build(nodes, x) for x in own}
        if n.kind == "array":
            return [build(nodes, x) for x in own]
        return n.scalar if n.kind == "string" else None if n.scalar is None else json.loads(n.scalar)

    assert [build(by[i], by[i][0]) for i in range(len(docs))] == docs


@pytest.mark.parametrize("name", sorted(problems.SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("claims", "temporal_facts", "labels", "entity_docs"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(problems.SQL[name]).df()
    got = problems.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


def test_found_rows(spark, sf):
    found = problems.p4_found(spark, sf)
    assert found.columns == ["row_no", "pid", "claim_no", "qual_pid", "qual_no", "snak_value"] and found.count() > 100


def test_a_day_that_moves_between_lists_is_a_change(spark, rows):
    day, other = dt.date(2010, 1, 1), dt.date(2011, 1, 1)
    states = {1: ([day], []), 2: ([day, other], []), 3: (None, [day]), 4: ([day], [other])}, {1: ([], [day]), 2: ([day], [other]), 3: ([], [day]), 4: ([day], [other])}
    df = spark.createDataFrame([(s, 2020 + i, *ab) for i, by in enumerate(states) for s, ab in by.items()], "s int, y int, a array<date>, b array<date>")
    got = snapshots.snapshot_changes(df, ["s"], "y", [F.col("a"), F.col("b")])
    assert rows(got) == [(2021, 1, "changed"), (2021, 2, "changed"), (2021, 3, "changed")]


def test_a_parent_that_is_not_chosen_is_a_root(spark, rows):
    df = spark.createDataFrame([(1, 5, 2), (1, 5, 9), (1, 2, 1), (2, 3, 3), (2, 3, 7)], "t int, n bigint, up bigint")
    assert rows(hierarchy.hierarchy(df, "t", "n", "up")) == [(1, 1, 1, 0, (1,)), (1, 2, 1, 1, (1, 2)), (1, 5, 1, 2, (1, 2, 5)), (1, 9, 9, 0, (9,)), (2, 3, None, -1, None), (2, 7, 7, 0, (7,))]


def test_nodes_rebuild_every_line_of_the_table(spark, sf):
    """The adjacency table of all lines against what Python's json reads."""
    from annalist.plans import problems

    nodes: dict = {}
    for r in problems.p4_nodes(spark, sf).collect():
        nodes.setdefault(r.row_no, []).append(r)

    def build(rows):
        rows.sort(key=lambda r: r.node)
        values = [{} if r.kind == "object" else [] if r.kind == "array" else r.scalar if r.kind == "string" else json.loads(r.scalar) if r.scalar is not None else None for r in rows]
        for r, v in zip(rows, values, strict=True):
            if r.parent >= 0:
                box = values[r.parent]
                box.__setitem__(r.label, v) if isinstance(box, dict) else box.append(v)
        return values[0]

    kept = 0
    for row_no, line in spark.read.parquet(f"{sf}/entity_docs.parquet").select("row_no", "line").collect():
        text = (line or "").strip(" \t\r\n\ufeff\x00").removesuffix(",")
        try:
            want = json.loads(text)
        except ValueError:
            assert row_no not in nodes
        else:
            kept += 1
            assert build(nodes[row_no]) == want
    assert kept > 20
