"""The pipeline's operators: truth at anchors, joins, samples, generated questions, evaluation, sources and sinks."""

import bz2
import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from annalist.operators import claims as C
from annalist.operators import evaluate as E
from annalist.operators import generate as G
from annalist.operators import joins, labels, sampling, truth
from annalist import schemas
from annalist.functions import text
from annalist.functions.text import seeded
from annalist.plans import catalog, sqltext
from annalist.schemas import CLAIM_SCHEMA
from annalist.sources import readers, sinks
from annalist.streaming.claims import stream_claims, write_claims_stream

D = dt.date


@pytest.mark.parametrize(
    "start,end,pit,held",
    [(None, None, D(2022, 1, 15), True), (D(2000, 1, 1), D(2030, 1, 1), D(2021, 7, 1), False), (D(2022, 7, 1), None, None, True), (None, D(2022, 7, 1), None, True), (D(2022, 7, 2), None, None, False), (None, D(2022, 6, 30), None, False), (D(2000, 1, 1), None, None, True), (None, D(2030, 1, 1), None, True)],
)
def test_valid_at(spark, start, end, pit, held):
    df = spark.createDataFrame([(start, end, pit)], "s date, e date, p date")
    assert df.select(truth.valid_at(F.lit(D(2022, 7, 1)), F.col("s"), F.col("e"), F.col("p"))).first()[0] is held


def test_truth_and_best(spark):
    rows = [
        (2022, "Q1", "P39", "Q5", "normal", ["2020-01-01"], None, None), (2022, "Q1", "P39", "Q4", "normal", ["2020-01-01"], None, None), (2022, "Q1", "P39", "Q9", "preferred", ["2021-01-01"], ["2022-03-01"], None),
        (2022, "Q1", "P39", "Q3", "deprecated", None, None, None), (2022, "Q2", "P17", "Q2", "normal", None, None, None), (2022, "Q2", "P17", "Q7", "normal", None, [], ["bad"]), (2022, "Q2", "P17", None, "normal", None, None, None), (2022, "Q2", "P17", "Q7", None, None, None, None),
    ]
    df = truth.with_days(spark.createDataFrame(rows, "snapshot_year int, subject_qid string, pid string, value_qid string, rank string, q_start_time array<string>, q_end_time array<string>, q_point_in_time array<string>"))
    all_ = truth.build_truth(df, ("01-01", "07-01"))
    best = {(str(r.anchor_date), r.truth_type, r.subject_qid): r.value_qid for r in truth.best_truth(all_).collect()}
    assert best == {("2022-01-01", "temporal", "Q1"): "Q9", ("2022-07-01", "temporal", "Q1"): "Q4", ("2022-01-01", "timeless", "Q2"): "Q7", ("2022-07-01", "timeless", "Q2"): "Q7"}
    assert all_.count() == 7 and truth.latest_anchor(all_).select("anchor_date").distinct().count() == 1


def test_entity_lines(spark, rows):
    line = json.dumps(
        {"id": "Q1", "claims": {"P39": [{"mainsnak": {"snaktype": "value", "datavalue": {"value": {"entity-type": "item", "numeric-id": 5}}}, "qualifiers": {"P580": [{"snaktype": "value", "datavalue": {"value": {"time": "+1998-00-00T00:00:00Z"}}}, {"snaktype": "somevalue"}], "P155": [{"snaktype": "value", "datavalue": {"value": {"entity-type": "item", "numeric-id": 8}}}], "P1545": [{"snaktype": "value", "datavalue": {"value": "3a"}}]}}, {"rank": "deprecated", "mainsnak": {"snaktype": "value", "datavalue": {"value": {"entity-type": "item", "numeric-id": 6}}}}, {"mainsnak": {"snaktype": "novalue"}}], "P9999": []}}
    )
    df = spark.createDataFrame([(x,) for x in ["[", "]", None, "", "{bad", '{"id":"P31"}', '{"id":"Q1","claims":[]}', "﻿" + line + " ,\r"]], "line string")
    got = C.extract_claims(df, "line", 2020)
    assert got.columns == CLAIM_SCHEMA.names
    assert rows(got.select("subject_qid", "pid", "value_qid", "rank", "q_start_time", "q_follows", "q_series_ordinal", "q_end_time")) == [("Q1", "P39", "Q5", "normal", ("1998-01-01",), ("Q8",), ("3a",), None)]
    assert C.extract_claims(df, "line", 2020, qualifier_mode="first").first().start_time == "1998-01-01"


def test_labels(spark, rows):
    df = spark.createDataFrame([("Q1", "b", "en", "d"), ("Q1", "a", "en", None), ("Q2", "x", "fr", None), ("Q3", None, "en", None)], "id string, label string, len string, des string")
    assert rows(labels.one_label(labels.build_labels(df, "en"))) == [("Q1", "a")] and labels.build_labels(df, None).columns == ["id", "label", "lang", "description"]
    with pytest.raises(ValueError):
        labels.build_labels(df.drop("len"), "en")
    facts = spark.createDataFrame([("Q1", "Q2"), ("Q1", "Q9"), (None, "Q1")], "subject_qid string, value_qid string")
    assert labels.with_known_ids(facts, df, "id").count() == 1


def test_pairs_and_samples(spark):
    df = spark.createDataFrame([("g", i) for i in range(5)] + [("h", i) for i in range(2)] + [("k", 1)], "g string, i int")
    pairs = joins.pair_neighbours(df, ["g"], "i", 42, 4).groupBy("g").count().collect()
    assert {r[0]: r[1] for r in pairs} == {"g": 2, "h": 1}
    strata = spark.createDataFrame([(i, "a" if i < 100 else "b" if i < 105 else "c") for i in range(106)], "i int, s string")
    got = sampling.stratified_sample(strata, ["s"], 30, 42, "i")
    counts = {r[0]: r[1] for r in got.groupBy("s").count().collect()}
    assert got.count() == 30 and counts == {"a": 24, "b": 5, "c": 1}
    assert sampling.cap_rows(strata, 7, 1, ["i"]).count() == 7 and sampling.cap_rows(strata, 0, 1, ["i"]).count() == 106
    assert sorted(r.i for r in sampling.cap_rows(strata, 7, 1, ["i"]).collect()) == sorted(r.i for r in sampling.cap_rows(strata.repartition(9), 7, 1, ["i"]).collect())


@pytest.mark.parametrize("most", [None, 1, 7, 40, 400])
def test_ranks_by_buckets_equal_plain_ranks(spark, most):
    df = spark.createDataFrame([("g" if i % 3 else None, i) for i in range(300)] + [("k", i) for i in range(5)], "g string, i int")
    ranks = lambda large: sorted(((r.g, r.i, r._rn) for r in sampling.seeded_ranks(df, ["g"], seeded(42, F.col("i")), ["i"], most, large).collect()), key=str)
    assert ranks(50) == ranks(10_000) and len(ranks(50)) == (305 if not most else sum(min(most, n) for n in (100, 200, 5)))
    assert sampling.cap_groups(df, ["g"], most, 42, ["i"]).columns == ["g", "i"]


def test_one_row_a_side_and_the_entity_between(spark):
    rows = [(2022, D(2022, 1, 1), "temporal", "Land", q, p, f"{v} {q}", f"V{q}{p}", 2022) for q in ("Q1", "Q2") for p, v in (("P6", "Minister"), ("P35", "Head"))]
    schema = "snapshot_year int, anchor_date date, truth_type string, subject_label string, subject_qid string, pid string, value_label string, value_qid string, year int"
    best = spark.createDataFrame(rows, schema)
    assert G.carryover(best).count() == 2 and G.direct(best).count() == 2 and G.cross_entity_then(best).count() == 0
    hop = [(2022, D(2022, 1, 1), "temporal", *x, 2022) for x in (("Ann Lee", "Q1", "P108", "Acme", "Q2"), ("Acme", "Q2", "P17", "Norway", "Q3"), ("Acme", "Q2", "P127", "Holding", "Q4"), ("Holding", "Q4", "P169", "Bob Ray", "Q5"))]
    best = spark.createDataFrame(hop, schema)
    got = {(r.question.split()[4], r.subject_label, r.subject_qid, r.pid, r.answer) for r in G.multihop_2(best).collect()}
    assert ("Ann", "Acme", "Q2", "P127", "Holding") in got or ("Ann", "Acme", "Q2", "P17", "Norway") in got
    assert all(r[1] != "Ann Lee" for r in got)
    assert [(r.subject_label, r.subject_qid, r.pid, r.answer) for r in G.multihop_3(best).collect()] == [("Holding", "Q4", "P169", "Bob Ray")]


def test_anchors_are_consecutive_within_a_year(spark):
    rows = [(y, D(y, m, 1), "temporal", "S", "Q1", p, f"V {p}{m}", "Q2", y) for y in (2021, 2022) for m in (1, 10) for p in ("P6", "P35", "P108")]
    best = spark.createDataFrame(rows, "snapshot_year int, anchor_date date, truth_type string, subject_label string, subject_qid string, pid string, value_label string, value_qid string, year int")
    got = {(r.anchor_date, r.next_anchor) for r in joins.consecutive_anchors(best, ["truth_type", "subject_label"]).collect()}
    assert got == {(D(y, 1, 1), D(y, 10, 1)) for y in (2021, 2022)}
    assert {len(r.turns) for r in G.cross_anchor_switch(best).collect()} <= {3, 4}


def test_the_sql_has_the_same_fixed_values():
    assert sqltext.BAD_LABELS == schemas.BAD_LABELS and sqltext.COMPLEMENTS == schemas.COMPLEMENTS and sqltext.TWO_HOPS == schemas.TWO_HOPS
    assert sqltext.PROPERTIES == [p[:3] for p in schemas.PROPERTIES] and sqltext.COUNTED == schemas.COUNTED and sqltext.LEADS == text.LEADS


def test_hops(spark):
    rows = [("s", "a", "P131", "b"), ("s", "b", "P17", "y"), ("s", "b", "P17", "x"), ("s", "b", "P31", "n"), ("t", "a", "P131", "b"), ("s", "a", "P108", "f"), ("s", "f", "P127", "o"), ("s", "o", "P169", "c"), ("s", "f", "P17", "z")]
    df = spark.createDataFrame(rows, "w string, subject_label string, pid string, value_label string")
    two = {(r.subject_label, r.pid, r.n_pid, r.n_value_label) for r in joins.hop_join(df, ["w"]).collect()}
    assert two == {("a", "P131", "P17", "x"), ("a", "P108", "P127", "o"), ("f", "P127", "P169", "c")}
    three = joins.three_hop_join(df, ["w"]).collect()
    assert [(r.subject_label, r.t_value_label) for r in three] == [("a", "c")]


def facts(spark):
    rows, day = [], D(2022, 1, 1)
    for a in (day, D(2022, 4, 1)):
        for i in range(12):
            for p, v in (("P35", "Head"), ("P6", "Minister"), ("P108", "Firm"), ("P463", "Club"), ("P17", "Land"), ("P131", "Shire")):
                for y in (2015, 2016, 2017, 2018)[: 1 + i % 4]:
                    rows.append((2022, a, "temporal", f"Subject {i}", f"Q{i}", p, f"{v} {i}{y}", f"Q9{i}", y))
    return spark.createDataFrame(rows, "snapshot_year int, anchor_date date, truth_type string, subject_label string, subject_qid string, pid string, value_label string, value_qid string, year int")


def test_generated(spark):
    rich = facts(spark)
    best = rich.groupBy("snapshot_year", "anchor_date", "truth_type", "subject_label", "subject_qid", "pid").agg(F.min("value_label").alias("value_label"), F.min("value_qid").alias("value_qid"), F.min("year").alias("year"))
    made = G.all_chains(best, rich)
    families = {r[0] for r in made.select("family").distinct().collect()}
    assert families == {"carryover", "carryover_then", "cross_entity_then", "scope_switch", "multi_turn_chain", "temporal_narrative", "change_point"}
    for r in made.collect():
        assert [t.turn_index for t in r.turns] == list(range(len(r.turns))) and len({t.question.lower() for t in r.turns}) == len(r.turns)
        assert r.difficulty.hops == len(r.turns) and all(10 <= len(t.question) <= 180 and t.question.endswith("?") for t in r.turns)
    flat = G.all_flat(best, rich)
    assert flat.select(F.lower("question"), "anchor_date").distinct().count() == flat.count() and flat.select("id").distinct().count() == flat.count()
    crossed = G.cross_anchor_switch(best)
    assert crossed.count() == 12 and crossed.filter((F.size("turns") < 3) | (F.size("turns") > 5)).count() == 0
    again = G.all_chains(best.repartition(7), rich.repartition(3))
    assert sorted(r[0] for r in made.select("chain_id").collect()) == sorted(r[0] for r in again.select("chain_id").collect())
    assert {r.family for r in G.family_stats(flat, made).collect()} >= families


def dialogues(spark):
    turns = [{"turn_index": i, "question": f"Which was number {i}?", "answer": f"Answer {i}"} for i in range(4)]
    return spark.createDataFrame([("c1", "carryover", turns, "Answer 0"), ("c2", "carryover", turns[:2], None), ("c3", "direct", turns[:1], "x")], "chain_id string, family string, turns array<struct<turn_index:int,question:string,answer:string>>, present_day_answer string")


def test_evaluation_of_gold_and_present(spark):
    turns = E.explode_turns(dialogues(spark))
    assert turns.count() == 6
    gold = E.overlaps(E.score(turns.withColumn("preds", F.array("answer"))))
    overall = E.turn_metrics(gold).filter("grouping = 'overall'").first()
    assert (overall.acc1, overall.acck, overall.drift1_rate, overall.token_f1, overall.char3_f1) == (1, 1, 0, 1, 1)
    chains = E.chain_metrics(gold).filter("grouping = 'overall'").first()
    assert (chains.n_chains, chains.strict_acc, chains.mean_turn_acc, chains.final_acc1) == (2, 1, 1, 1)
    now = E.score(turns.filter("turn_index > 0 and present_day_answer is not null").withColumn("preds", F.array(F.col("present_day_answer"), F.lit("zzz"))))
    assert now.filter("drift1 and driftk and not correct1 and error_label = 'drift'").count() == now.count() == 3
    assert E.score(turns.withColumn("preds", F.array().cast("array<string>"))).filter("correct1 or correctk or drift1").count() == 0
    assert E.score(turns.withColumn("preds", F.array(F.lit("answer 1"))), mode="exact").filter("correct1").count() == 2
    assert E.examples(gold, most=8).count() == 2


def test_context_and_generators(spark):
    turns = E.explode_turns(dialogues(spark), scope_turns_only=True)
    assert turns.agg(F.min("turn_index"), F.min("follow_pos")).first() == (1, 1)
    all_turns = E.context(E.explode_turns(dialogues(spark)))
    r = all_turns.filter("chain_id = 'c2' and turn_index = 1").select(E.prompt("messages", "Be brief."), E.alternates("messages")).first()
    assert r[0] == "Be brief.\nUser: Which was number 0?\nAssistant: Answer 0\nUser: Which was number 1?\nAssistant:" and r[1]
    asked = all_turns.select("chain_id", "turn_index", E.prompt("messages").alias("prompt"))
    assert {x for r in E.generate_predictions(asked, lambda ps: [[str(len(p)), "b"] for p in ps], 2).collect() for x in r.preds[1:]} == set()
    own = E.answer_in_turn(all_turns, lambda ps: [[f"{p.count('Assistant: ')}"] for p in ps])
    assert sorted((r.chain_id, r.turn_index, r.preds[0]) for r in own.collect()) == sorted((r.chain_id, r.turn_index, str(r.turn_index)) for r in all_turns.collect())
    two = spark.createDataFrame([(None, {"P6": "A", "P35": "B"}, "P6"), (None, {"P6": "A", "P35": "B"}, "P39"), (None, {"P6": "A"}, "P39"), ("A", None, "P1")], "t string, m map<string,string>, p string")
    assert [r[0] for r in two.select(E.present_answer(F.col("t"), F.col("m"), F.col("p"))).collect()] == ["A", None, "A", "A"]


def test_present_day(spark):
    left = spark.createDataFrame([("s", "P6", "a"), ("s", "P6", "b"), ("t", "P6", "a")], "subject_label string, pid string, answer string")
    now = spark.createDataFrame([("s", "P6", "b", "Q2"), ("s", "P6", "a", "Q1")], "subject_label string, pid string, value_label string, value_qid string")
    got = {(r.subject_label, r.answer): (r.present_day_answer, r.drift_eligible) for r in joins.annotate_present(left, now).collect()}
    assert got == {("s", "a"): ("a", False), ("s", "b"): ("a", True), ("t", "a"): (None, False)}


def test_sources_and_sinks(spark, tmp_path, rows):
    zstandard = pytest.importorskip("zstandard")
    doc = '{"id":"Q%d","claims":{"P31":[{"mainsnak":{"snaktype":"value","datavalue":{"value":{"entity-type":"item","numeric-id":5}}}}]}}'
    shards = tmp_path / "shards" / "2020"
    shards.mkdir(parents=True)
    for i in range(2):
        (shards / f"entities-2020-part-0000{i}.jsonl.zst").write_bytes(zstandard.compress(f"{doc % i}\n\n{{bad\n".encode()) + zstandard.compress(b"\n[\n"))  # two frames
    raw = tmp_path / "raw" / "2021"
    raw.mkdir(parents=True)
    (raw / "a.json.bz2").write_bytes(bz2.compress(b"[\n" + (doc % 7).encode() + b",\n" + (doc % 8).encode() + b"\n]\n"))
    assert C.extract_claims(readers.read_entities(spark, str(tmp_path), 2020), "line", 2020).count() == 2
    claims = C.extract_claims(readers.read_entities(spark, str(tmp_path), 2021), "line", 2021)
    assert rows(claims.select("subject_qid")) == [("Q7",), ("Q8",)]
    with pytest.raises(FileNotFoundError):
        readers.list_shards(str(shards), 1999)
    path = str(tmp_path / "claims")
    sinks.write_claims(claims, path)
    sinks.write_claims(claims.withColumn("snapshot_year", F.lit(2022)), path)
    assert readers.read_claims(spark, path).count() == 4 and readers.read_claims(spark, path, 2021).count() == 2 and sinks.is_done(path + '/snapshot_year=2021') and not sinks.is_done(path + '/snapshot_year=1900')
    dated = claims.withColumns({"start_date": F.lit(None).cast("date"), "end_date": F.lit(None).cast("date"), "pit_date": F.lit(None).cast("date")})
    all_ = truth.build_truth(dated)
    sinks.write_truth(all_, truth.best_truth(all_), str(tmp_path / "truth"))
    assert readers.read_truth(spark, str(tmp_path / "truth"), "timeless", "best", ["2021-04-01"]).count() == 2
    assert readers.truth_file_parts("truth_temporal_anchor=2022-01-01.parquet") == ("temporal", "2022-01-01") and readers.truth_file_parts("truth_temporal_all_active_anchor=2022-01-01.parquet") is None
    chains = dialogues(spark)
    sinks.write_jsonl(chains, str(tmp_path / "chains"))
    assert rows(readers.read_chains(spark, str(tmp_path / "chains"), chains.schema).select("chain_id")) == [("c1",), ("c2",), ("c3",)]
    metrics = E.turn_metrics(E.overlaps(E.score(E.explode_turns(chains).withColumn("preds", F.array("answer")))))
    for _ in range(2):
        sinks.append_summary(str(tmp_path / "s.tsv"), "m", "gold", metrics)
    lines = (tmp_path / "s.tsv").read_text().splitlines()
    assert lines[0].startswith("model\tcontext") and len(lines) == 1 + 2 * metrics.count() and "1.000000" in lines[1]
    sinks.write_json_result({"gold": metrics}, str(tmp_path / "r.json"), seed=42)
    assert json.loads((tmp_path / "r.json").read_text())["seed"] == 42
    assert sinks.write_label_table(spark.createDataFrame([("Q1", "a")], "id string, label string"), str(tmp_path / "labels")) == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"id":"Q1","claims":{"P31":[{"mainsnak":{"snaktype":"value","datavalue":{"value":{"entity-type":"item","numeric-id":5}}}}]}}\n[\n')
    write_claims_stream(stream_claims(spark, str(tmp_path / "in"), 2020), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_entity_pairs_have_their_own_cap(spark):
    rows = spark.range(2400 * 5).select(F.lit(2022).alias("snapshot_year"), F.lit(D(2022, 1, 1)).alias("anchor_date"), F.lit("temporal").alias("truth_type"), F.format_string("Subject %d", F.floor(F.col("id") / 5).cast("bigint")).alias("subject_label"), F.lit("Q1").alias("subject_qid"), F.lit("P108").alias("pid"), F.format_string("Firm %d", F.col("id")).alias("value_label"), F.lit("Q2").alias("value_qid"), F.lit(2015).alias("year"))
    flat = G.all_flat(rows.filter("false"), rows)
    assert flat.filter("family = 'complex_sum_two_entities'").count() == 1200
    assert G.Caps().entity_pairs == 20_000 and G.Caps().pairs == 2000


def test_queries_process_every_anchor(spark, tmp_path):
    day = lambda m: [f"+2022-{m}-15T00:00:00Z"]
    claims = [(2022, s, p, v, "normal", day(a), day(b)) for s, p, v, a, b in (("Q1", "P131", "Q2", "03", "05"), ("Q2", "P131", "Q3", "03", "05"), ("Q3", "P17", "Q4", "03", "05"), ("Q1", "P39", "Q5", "09", "11"))]
    claims += [(2022, "Q1", p, f"Q{6 + i}", "normal", None, None) for i, p in enumerate(("P39", "P54", "P102"))]
    text = spark.createDataFrame(claims, "snapshot_year int, subject_qid string, pid string, value_qid string, rank string, q_start_time array<string>, q_end_time array<string>")
    absent = [f.name for f in CLAIM_SCHEMA if f.name.startswith("q_") and f.name not in text.columns]
    text.select("*", *(F.lit(None).cast("array<string>").alias(c) for c in absent)).write.parquet(str(tmp_path / "claims.parquet"))
    names = [(f"Q{i}", n, "en", None) for i, n in enumerate(("Ashford", "Barrow", "Corby", "Derby", "Mayor", "Exeter", "Forest", "Gambia"), 1)]
    spark.createDataFrame(names, "id string, label string, lang string, description string").write.parquet(str(tmp_path / "labels.parquet"))
    at = lambda q: {str(r.anchor_date)[5:] for r in catalog.QUERIES[q](spark, str(tmp_path)).select("anchor_date").collect()}
    assert at("truth_temporal_best") == at("truth_temporal_all") == {"04-01", "10-01"}
    assert at("truth_timeless_best") == at("truth_timeless_all") == {"01-01", "04-01", "07-01", "10-01"}
    assert at("two_hop_first") == at("three_hop_first") == at("multihop_questions") == {"04-01"}
    assert at("multi_turn_chains") == {"01-01", "04-01", "07-01", "10-01"}


@pytest.mark.parametrize("name", ["truth_temporal_best", "truth_temporal_all", "truth_timeless_best", "truth_timeless_all", "two_hop_first", "three_hop_first"])
def test_queries_at_anchors_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("claims", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(catalog.SQL[name]).df()
    got = catalog.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    plain = lambda df: sorted((tuple(None if v is None or v != v else str(v) for v in r) for r in df.itertuples(index=False, name=None)), key=str)
    assert plain(got) == plain(want)
    assert set(got.anchor_date.str[4:]) == {"-01-01", "-04-01", "-07-01", "-10-01"}
