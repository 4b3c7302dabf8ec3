"""Questions and question chains from rows that hold at an anchor, in deterministic order and wording.

Rows have anchor_date, snapshot_year, truth_type, subject_label, subject_qid, pid, value_label, value_qid and year (the year their
qualifiers speak of). ``best`` rows are one for each subject and property, ``rich`` ones all that hold. Choices that the
reference leaves to chance follow the md5 of a seed and the key. Each family is a plan of joins, groupings and windows; arrays are
built only within a chain (at most six turns) or of a subject's properties (at most 19).

A flat question passes the gate for questions and is unique by its wording within (snapshot_year, anchor_date, truth_type); a chain passes
the gate for chains. Labels are the keys of subjects and values, as in the reference, so entities of one label merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import coin, good_chain, good_question, plural, question_key, seeded
from ..schemas import COUNTED, GROUPS, PROPERTIES, WORDINGS
from .joins import complement_join, consecutive_anchors, hop_join, one_each, pair_neighbours, three_hop_join
from .sampling import cap_groups

SCOPE = ["snapshot_year", "anchor_date", "truth_type"]
ROW = [*SCOPE, "subject_label", "subject_qid", "pid", "value_label", "value_qid", "year"]
TURN = ["question", "answer", "year", "pid", "subject_label", "subject_qid", "value_label", "value_qid"]
FLAT_ORDER = ["direct", "multihop_2", "multihop_3", "complex_count_distinct", "complex_sum_two_entities", "complex_diff_two_entities"]


@dataclass(frozen=True)
class Caps:
    """Greatest number of rows of each family and anchor, the feature's own limits; None or 0 means no limit."""

    multi_turn: int | None = 50_000
    scope_switch: int | None = 50_000
    narrative: int | None = 60_000
    change_point: int | None = 60_000
    two_hop: int | None = 150_000
    three_hop: int | None = 50_000
    complex: int | None = 100_000
    cross_anchor: int | None = 20_000
    pairs: int | None = 2000
    entity_pairs: int | None = 20_000


def _map(position: int) -> Column:
    return F.create_map(*(F.lit(x) for p in PROPERTIES for x in (p[0], p[position])))


def question(form: str, pid: Column, subject: Column | None = None, year: Column | None = None, key: Column | None = None) -> Column:
    """Question of a form for a property; of its two wordings the key's md5 picks one."""
    slots = {"{q}": F.try_element_at(_map(1), pid), "{m}": F.try_element_at(_map(2), pid), "{s}": subject, "{y}": None if year is None else F.coalesce(year.cast("string"), F.lit(""))}

    def fill(text: str) -> Column:
        parts, rest = [], text
        while rest:
            at, slot = min(((rest.find(s), s) for s in slots if s in rest), default=(len(rest), None))
            parts += [F.lit(rest[:at])] if at else []
            parts += [slots[slot]] if slot else []
            rest = rest[at + len(slot) :] if slot else ""
        return F.concat(*parts)

    first, second = WORDINGS[form]
    return F.when(coin(50, form, pid, key if key is not None else pid), fill(first)).otherwise(fill(second))


def explicit(prefix: str = "") -> Column:
    """First question about a row: with its snapshot year where the row is temporal, without where it is timeless."""
    c = lambda n: F.col(prefix + n)
    named = dict(pid=c("pid"), subject=c("subject_label"), key=c("subject_label"))
    return F.when(c("truth_type") == "timeless", question("explicit_timeless", **named)).otherwise(question("explicit_temporal", year=c("snapshot_year"), **named))


def turn(text: Column, prefix: str = "", year: Column | None = None, index: int | None = None) -> Column:
    c = lambda n: F.col(prefix + n)
    head = [] if index is None else [F.lit(index).alias("turn_index")]
    return F.struct(*head, text.alias("question"), c("value_label").alias("answer"), (c("year") if year is None else year).cast("int").alias("year"), *(c(n).alias(n) for n in TURN[3:]))


def difficulty(family: str, hops: Column) -> Column:
    return F.struct(hops.cast("int").alias("hops"), (F.col("truth_type") == "temporal").alias("temporal"), F.lit(family.startswith("complex_")).alias("analytic"))


def flat(df: DataFrame, family: str, hops: int = 1) -> DataFrame:
    """Rows with question and answer that pass the gate, as questions of a family."""
    missing = {n: F.lit(None).cast("string") for n in ("value_label", "value_qid") if n not in df.columns}
    rows = df.withColumns(missing) if missing else df
    rows = rows.filter(good_question("question", "answer"))
    return rows.select(F.lit(family).alias("family"), *SCOPE, "question", "answer", "pid", "subject_label", "subject_qid", "value_label", "value_qid", F.col("year").cast("int").alias("year"), difficulty(family, F.lit(hops)).alias("difficulty"))


def unique_questions(df: DataFrame) -> DataFrame:
    """One row for each wording within (snapshot_year, anchor_date, truth_type), the earliest family first; adds ``id``."""
    place = F.array_position(F.array(*(F.lit(f) for f in FLAT_ORDER)), F.col("family"))
    w = Window.partitionBy(*SCOPE, question_key("question")).orderBy(place, *TURN[1:])
    kept = df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return kept.withColumn("id", F.md5(F.concat_ws("|", "family", *(F.col(c).cast("string") for c in SCOPE), "question")))


def chains(df: DataFrame, family: str, turns: Column | str = "turns") -> DataFrame:
    """Rows with an array of turns that passes the gate, as chains of a family."""
    t = F.col(turns) if isinstance(turns, str) else turns
    rows = df.withColumn("turns", F.transform(t, lambda x, i: F.struct(i.alias("turn_index"), *(x[n].alias(n) for n in TURN)))).filter(good_chain("turns"))
    key = F.concat_ws("|", F.lit(family), *(F.col(c).cast("string") for c in SCOPE), F.to_json("turns"))
    return rows.select(F.md5(key).alias("chain_id"), F.lit(family).alias("family"), *SCOPE, difficulty(family, F.size("turns")).alias("difficulty"), "turns")


def turn_rows(df: DataFrame) -> DataFrame:
    """One flat row for each turn of chains."""
    return df.select("chain_id", "family", *SCOPE, F.inline("turns"))


# Flat families


def direct(best: DataFrame) -> DataFrame:
    """One question for each subject label and property."""
    return flat(one_each(best, [*SCOPE, "subject_label", "pid"]).withColumns({"question": explicit(), "answer": F.col("value_label"), "year": F.col("snapshot_year")}), "direct")


def multihop_2(best: DataFrame) -> DataFrame:
    """Second hop of a row, asked about by way of the first; subject, property and value are those of the second, so its subject is the entity between."""
    met = hop_join(best.select(*ROW), SCOPE)
    asked = F.concat(F.lit("Taking the "), F.try_element_at(_map(2), F.col("pid")), F.lit(" of "), F.col("subject_label"), F.lit(", "), F.try_element_at(_map(1), F.col("n_pid")), F.lit(" is its "), F.try_element_at(_map(2), F.col("n_pid")), F.lit("?"))
    return flat(met.select(*SCOPE, F.col("value_label").alias("subject_label"), F.col("value_qid").alias("subject_qid"), F.col("n_pid").alias("pid"), F.col("n_value_label").alias("value_label"), F.col("n_value_qid").alias("value_qid"), F.col("snapshot_year").alias("year"), asked.alias("question"), F.col("n_value_label").alias("answer")), "multihop_2", 2)


def multihop_3(best: DataFrame) -> DataFrame:
    """Third hop of a row; subject, property and value are those of the third, so its subject is the last entity between."""
    met = three_hop_join(best.select(*ROW), SCOPE)
    asked = F.concat(F.lit("Who is chief executive of the owner of the employer of "), F.col("subject_label"), F.lit("?"))
    return flat(met.select(*SCOPE, F.col("n_value_label").alias("subject_label"), F.col("n_value_qid").alias("subject_qid"), F.col("t_pid").alias("pid"), F.col("t_value_label").alias("value_label"), F.col("t_value_qid").alias("value_qid"), F.col("snapshot_year").alias("year"), asked.alias("question"), F.col("t_value_label").alias("answer")), "multihop_3", 3)


def value_counts(rich: DataFrame, keys: list[str], pids: list[str] = COUNTED) -> DataFrame:
    """keys and n_values: number of distinct values of the counted properties."""
    return rich.filter(F.col("pid").isin(pids)).groupBy(*keys).agg(F.count_distinct("value_label").alias("n_values"), F.min("subject_qid").alias("subject_qid"))


def count_distinct(rich: DataFrame) -> DataFrame:
    counts = value_counts(rich, [*SCOPE, "subject_label", "pid"]).filter("n_values >= 2")
    have = F.when(F.col("truth_type") == "timeless", F.concat(F.lit(" does "), F.col("subject_label"), F.lit(" have?"))).otherwise(F.concat(F.lit(" did "), F.col("subject_label"), F.lit(" have in "), F.col("snapshot_year").cast("string"), F.lit("?")))
    asked = F.concat(F.lit("How many "), plural(F.try_element_at(_map(2), F.col("pid"))), have)
    return flat(counts.withColumns({"question": asked, "answer": F.col("n_values").cast("string"), "year": F.col("snapshot_year")}), "complex_count_distinct")


def two_entities(rich: DataFrame, seed: str | int = 42, cap: int | None = 20_000) -> DataFrame:
    """Pairs of subjects of a property in one qualifier year with both counts: n_a, n_b."""
    keys = [*SCOPE, "pid", "year"]
    counts = value_counts(rich.filter((F.col("truth_type") != "timeless") & F.col("year").isNotNull()), [*keys, "subject_label"])
    pairs = pair_neighbours(counts, keys, "subject_label", seed, cap)
    side = lambda x: counts.select(*keys, F.col("subject_label").alias(x), F.col("n_values").alias(f"n_{x}"))
    return pairs.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])


def _arithmetic(pairs: DataFrame, family: str, word: str, answer: Column) -> DataFrame:
    asked = F.concat(F.lit(f"Counting {word} "), plural(F.try_element_at(_map(2), F.col("pid"))), F.lit(" of "), F.col("a"), F.lit(" and "), F.col("b"), F.lit(" in "), F.col("year").cast("string"), F.lit(", what is the number?"))
    return flat(pairs.select(*SCOPE, "pid", "year", F.concat_ws(" & ", "a", "b").alias("subject_label"), F.lit(None).cast("string").alias("subject_qid"), asked.alias("question"), answer.cast("string").alias("answer")), family)


def sum_two_entities(rich: DataFrame, seed: str | int = 42, cap: int | None = 20_000) -> DataFrame:
    return _arithmetic(two_entities(rich, seed, cap), "complex_sum_two_entities", "together the", F.col("n_a") + F.col("n_b"))


def diff_two_entities(rich: DataFrame, seed: str | int = 42, cap: int | None = 20_000) -> DataFrame:
    return _arithmetic(two_entities(rich, seed, cap).filter(F.col("n_a") != F.col("n_b")), "complex_diff_two_entities", "the difference in", F.col("n_a") - F.col("n_b"))


# Chains


def carryover(best: DataFrame, then: bool = False) -> DataFrame:
    """A property, then the one that completes it; with ``then`` in the past tense and for temporal rows only."""
    rows = best.select(*ROW)
    met = complement_join(rows.filter(F.col("truth_type") == "temporal") if then else rows, [*SCOPE, "subject_label"])
    second = question("followup_then" if then else "followup", F.col("b_pid"), key=F.col("subject_label"))
    return chains(met.withColumn("turns", F.array(turn(explicit(), year=F.col("snapshot_year")), turn(second, "b_", F.col("snapshot_year")))), "carryover_then" if then else "carryover")


def cross_entity_then(best: DataFrame, seed: str | int = 42, cap: int | None = 2000) -> DataFrame:
    """The same property of two subjects, paired in seeded order; pairs of one label are left out."""
    rows = best.select(*ROW)
    keys = [*SCOPE, "pid"]
    pairs = pair_neighbours(rows, keys, "subject_qid", seed, cap)
    a = rows.withColumn("a", F.col("subject_qid"))
    b = rows.select(*keys, F.col("subject_qid").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ROW))
    met = pairs.join(a, [*keys, "a"]).join(b, [*keys, "b"]).filter(F.col("subject_label") != F.col("b_subject_label"))
    asked = [question(form, F.col("b_pid"), key=F.col("b_subject_label")) for form in ("followup", "followup_then")]
    second = F.concat(F.lit("Turning to "), F.col("b_subject_label"), F.lit(": "), F.lower(F.when(F.col("truth_type") == "timeless", asked[0]).otherwise(asked[1])))
    return chains(met.withColumn("turns", F.array(turn(explicit(), year=F.col("snapshot_year")), turn(second, "b_", F.col("snapshot_year")))), "cross_entity_then")


def by_year(rows: DataFrame, keys: list[str], seed: str | int = 42) -> DataFrame:
    """One row for each key and qualifier year, the first in seeded order of its value."""
    return one_each(rows.filter(F.col("year").isNotNull()), [*keys, "year"], seed)


def scope_switch(rows: DataFrame, seed: str | int = 42) -> DataFrame:
    """One fact in two of its years; of the years of a key the first two in seeded order."""
    keys = [*SCOPE, "subject_label", "pid"]
    years = by_year(rows.filter(F.col("truth_type") == "temporal").select(*ROW), keys, seed)
    w = Window.partitionBy(*keys).orderBy(seeded(seed, F.col("subject_label"), F.col("year")), "year")
    two = years.withColumn("_k", F.row_number().over(w)).filter("_k <= 2").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", *(c for c in ROW if c not in keys)))).alias("_r")).filter(F.size("_r") == 2)
    c = lambda i, n: F.get("_r", F.lit(i))[n]
    met = two.select(*keys, *(c(0, n).alias(n) for n in ROW if n not in keys), *(c(1, n).alias(f"b_{n}") for n in ROW if n not in keys), *(F.col(k).alias(f"b_{k}") for k in keys))
    first = question("explicit_temporal", F.col("pid"), F.col("subject_label"), F.col("year"), F.col("subject_label"))
    second = question("switch", F.col("pid"), year=F.col("b_year"), key=F.col("subject_label"))
    return chains(met.withColumn("turns", F.array(turn(first), turn(second, "b_"))), "scope_switch")


def temporal_narrative(rich: DataFrame, seed: str | int = 42, least: int = 3, most: int = 6) -> DataFrame:
    """A fact through three to six of its years in order."""
    keys = [*SCOPE, "subject_label", "pid"]
    years = by_year(rich.filter(F.col("truth_type") == "temporal").select(*ROW), keys, seed)
    w = Window.partitionBy(*keys).orderBy(seeded(seed, F.col("subject_label"), F.col("year")), "year")
    picked = years.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most)
    n = Window.partitionBy(*keys).orderBy("year")
    placed = picked.withColumns({"_i": F.row_number().over(n), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))}).filter(F.col("_n") >= least)
    first = question("explicit_temporal", F.col("pid"), F.col("subject_label"), F.col("year"), F.col("subject_label"))
    later = question("switch", F.col("pid"), year=F.col("year"), key=F.concat_ws("|", "subject_label", F.col("year").cast("string")))
    last = question("by_year", F.col("pid"), year=F.col("year"), key=F.col("subject_label"))
    text = F.when(F.col("_i") == 1, first).when((F.col("_i") == F.col("_n")) & (F.col("_i") > 2) & coin(50, seed, F.col("subject_label"), F.col("pid")), last).otherwise(later)
    told = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_i"), turn(text).alias("_t")))).alias("_l"))
    return chains(told.withColumn("turns", F.transform("_l", lambda x: x["_t"])), "temporal_narrative")


def change_point(rich: DataFrame, seed: str | int = 42) -> DataFrame:
    """Two completing facts before and after a change: both in one common year, then both in another; the first and last common years."""
    keys = [*SCOPE, "subject_label"]
    years = by_year(rich.filter(F.col("truth_type") == "temporal").select(*ROW), [*keys, "pid"], seed)
    met = complement_join(years, [*keys, "year"])
    pair = [*keys, "pid", "b_pid"]
    ends = met.groupBy(*pair).agg(*(f(F.struct("year", *(c for c in met.columns if c not in (*pair, "year")))).alias(n) for f, n in ((F.min, "_a"), (F.max, "_b")))).filter(F.col("_a.year") < F.col("_b.year"))

    def t(end: str, prefix: str, text: Column) -> Column:
        c = lambda n: F.col("subject_label") if n == "subject_label" else F.col(prefix + "pid") if n == "pid" else F.col(f"{end}.{prefix}{n}")
        return F.struct(text.alias("question"), c("value_label").alias("answer"), F.col(f"{end}.year").cast("int").alias("year"), *(c(n).alias(n) for n in TURN[3:]))

    ask = [
        question("explicit_temporal", F.col("pid"), F.col("subject_label"), F.col("_a.year"), F.col("subject_label")),
        question("followup_then", F.col("b_pid"), key=F.concat_ws("|", "subject_label", F.lit("a"))),
        F.concat(F.lit("Back to "), F.try_element_at(_map(2), F.col("pid")), F.lit(": "), F.lower(question("switch", F.col("pid"), year=F.col("_b.year"), key=F.col("subject_label")))),
        F.concat(F.lit("And in "), F.col("_b.year").cast("string"), F.lit(", "), F.lower(question("followup_then", F.col("b_pid"), key=F.concat_ws("|", "subject_label", F.lit("b"))))),
    ]
    return chains(ends.withColumn("turns", F.array(t("_a", "", ask[0]), t("_a", "b_", ask[1]), t("_b", "", ask[2]), t("_b", "b_", ask[3]))), "change_point")


def _draw(*parts) -> int:
    return int(md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def pick_properties(rows: list[dict], subject: str, scope: str, seed: str, least: int, most: int) -> list[dict]:
    """Rows of a multi-turn chain: seeded order, new groups of properties first once ``least`` is reached, no answer twice."""
    rows = sorted(rows, key=lambda r: (md5(f"{seed}|{subject}|{scope}|{r['pid']}".encode()).hexdigest(), r["pid"]))
    target = least + _draw(seed, subject, scope, "length") % (max(least, min(most, len(rows))) - least + 1)
    taken: list[dict] = []
    while rows and len(taken) < target:
        used = {GROUPS.get(r["pid"]) for r in taken}
        at = next((i for i, r in enumerate(rows) if GROUPS.get(r["pid"]) not in used), 0) if len(taken) >= least else 0
        r = rows.pop(at)
        if r["value_label"].lower() not in {x["value_label"].lower() for x in taken}:
            taken.append(r)
    return taken if len(taken) >= least else []


def multi_turn_chain(best: DataFrame, seed: str | int = 42, least: int = 3, most: int = 6) -> DataFrame:
    """Three to six properties of one subject. Which ones is a greedy choice over at most 19 rows, made in Python batches; the rest is built in."""
    rows = best.select(*ROW)
    keys = [*SCOPE, "subject_label"]
    w = Window.partitionBy(*keys, "pid").orderBy("value_qid", "value_label", "subject_qid")
    one = rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    asked = {f: question(f, F.col("pid"), key=F.concat_ws("|", "subject_label", "pid")) for f in ("followup", "followup_then")}
    one = one.withColumns({"q_first": explicit(), "q_next": asked["followup"], "q_then": asked["followup_then"]})
    fields = ["pid", "subject_qid", "value_label", "value_qid", "q_first", "q_next", "q_then"]
    groups = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_rows")).filter(F.size("_rows") >= least)
    shape = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n == "year" else T.StringType()) for n in TURN]))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                scope, told, words = f"{r.anchor_date}|{r.truth_type}", [], set()
                for x in pick_properties([dict(y) if isinstance(y, dict) else y.asDict() for y in r.rows], r.subject_label, scope, str(seed), least, most):
                    i, draw = len(told), _draw(seed, r.subject_label, scope, x["pid"], "form") % 100
                    if i == 0:
                        q = x["q_first"]
                    elif i >= 3 and draw < 40:
                        q = f"Turning to {r.subject_label}: {x['q_next'].lower()}"
                    else:
                        q = x["q_then"] if r.truth_type == "temporal" and draw < 35 else x["q_next"]
                    if q.lower() not in words:
                        words.add(q.lower())
                        told.append({"question": q, "answer": x["value_label"], "year": r.snapshot_year, "pid": x["pid"], "subject_label": r.subject_label, "subject_qid": x["subject_qid"], "value_label": x["value_label"], "value_qid": x["value_qid"]})
                out.append(told if len(told) >= least else None)
            yield part.drop(columns=["rows"]).assign(turns=pd.Series(out, index=part.index, dtype=object))

    told = groups.withColumnRenamed("_rows", "rows").mapInPandas(run, T.StructType([*groups.select(*keys).schema.fields, T.StructField("turns", shape)]))
    return chains(told.filter(F.col("turns").isNotNull()), "multi_turn_chain")


def cross_anchor_switch(best: DataFrame, seed: str | int = 42) -> DataFrame:
    """A subject at an anchor and at the next one of the year: two properties, then the first again and up to two further ones later. No gate, as in the reference."""
    keys = ["truth_type", "subject_label"]
    both = consecutive_anchors(best.select(*ROW), keys, seed=seed)
    group = Window.partitionBy(*keys, "anchor_date")
    placed = both.withColumns({"_k": F.row_number().over(group.orderBy(seeded(seed, F.col("subject_label"), F.col("pid")), "pid")), "_n": F.count(F.lit(1)).over(group)})
    draw = F.conv(F.substring(seeded(seed, F.col("subject_label"), F.col("anchor_date"), "length"), 1, 8), 16, 10).cast("bigint")
    plan = placed.filter(F.col("_k") <= 2 + draw % (F.least(F.lit(4), F.col("_n")) - 1))
    then = (F.col("truth_type") != "timeless") & coin(35, seed, F.col("subject_label"), F.col("pid"), "form")
    next_ = F.when(then, question("followup_then", F.col("pid"), key=F.col("subject_label"))).otherwise(question("followup", F.col("pid"), key=F.col("subject_label")))
    first = F.when(F.col("_k") == 1, explicit()).otherwise(next_)
    later = F.when(F.col("_k") == 1, question("switch", F.col("pid"), year=F.col("b_snapshot_year"), key=F.col("subject_label"))).otherwise(next_)
    old = F.when(F.col("_k") <= 2, F.struct(F.lit(0).alias("o"), F.col("_k").alias("k"), turn(first, year=F.col("snapshot_year")).alias("t")))
    new = F.when(F.col("_k") != 2, F.struct(F.lit(1).alias("o"), F.col("_k").alias("k"), turn(later, "b_", F.col("b_snapshot_year")).alias("t")))
    told = plan.groupBy(*keys, F.col("anchor_date").alias("anchor_from"), F.col("next_anchor").alias("anchor_to"), "snapshot_year").agg(F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array(old, new))))).alias("_l"))
    turns = F.transform(F.transform("_l", lambda x: x["t"]), lambda x, i: F.struct(i.alias("turn_index"), *(x[n].alias(n) for n in TURN)))
    out = told.withColumn("turns", turns).filter(F.size("turns") >= 3)
    return out.select(F.md5(F.concat_ws("|", F.lit("cross_anchor_switch"), "subject_label", F.col("anchor_from").cast("string"), F.to_json("turns"))).alias("chain_id"), F.lit("cross_anchor_switch").alias("family"), "snapshot_year", "anchor_from", "anchor_to", "truth_type", difficulty("cross_anchor_switch", F.size("turns")).alias("difficulty"), "turns")


def all_flat(best: DataFrame, rich: DataFrame, seed: str | int = 42, caps: Caps = Caps()) -> DataFrame:
    """All flat families within their caps, unique by wording."""
    capped = lambda d, n: cap_groups(d, ["anchor_date", "truth_type"], n, seed, ["question", "answer"])
    arithmetic = count_distinct(rich).unionByName(sum_two_entities(rich, seed, caps.entity_pairs)).unionByName(diff_two_entities(rich, seed, caps.entity_pairs))
    parts = [direct(best), capped(multihop_2(best), caps.two_hop), capped(multihop_3(best), caps.three_hop), capped(arithmetic, caps.complex)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return unique_questions(out)


def all_chains(best: DataFrame, rich: DataFrame, seed: str | int = 42, caps: Caps = Caps()) -> DataFrame:
    """All chain families of single anchors within their caps."""
    capped = lambda d, n: cap_groups(d, ["anchor_date", "truth_type"], n, seed, ["chain_id"])
    parts = [
        carryover(best), carryover(best, then=True), cross_entity_then(best, seed, caps.pairs), capped(scope_switch(rich, seed), caps.scope_switch),
        capped(multi_turn_chain(best, seed), caps.multi_turn), capped(temporal_narrative(rich, seed), caps.narrative), capped(change_point(rich, seed), caps.change_point),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def family_stats(flat_rows: DataFrame, chain_rows: DataFrame) -> DataFrame:
    """Number of questions and chains kept, by family."""
    return flat_rows.select("family").unionByName(chain_rows.select("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))
