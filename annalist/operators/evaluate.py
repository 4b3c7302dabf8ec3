"""Scoring of predictions against question chains: dialogue context, prompts, matches, drift, metrics and examples.

Predictions come from a table (chain_id, turn_index, preds) or from a function ``generate(prompts) -> list of list of text`` that is
called on batches; no model is part of this engine.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import match_key, meets, normalize, prepared

#: Texts of the prompt's lines (fixed values).
USER, ASSISTANT = "User: ", "Assistant: "


def explode_turns(chains: DataFrame, scope_turns_only: bool = False) -> DataFrame:
    """One row for each evaluated turn of chains with at least two turns; ``follow_pos`` counts evaluated turns from 1."""
    start = 1 if scope_turns_only else 0
    rows = chains.filter(F.size("turns") >= 2).withColumn("chain_length", F.size("turns"))
    turns = rows.select(*(c for c in rows.columns if c != "turns"), F.posexplode("turns").alias("turn_index", "_t")).filter(F.col("turn_index") >= start)
    plain = [f for f in chains.schema["turns"].dataType.elementType.names if f not in rows.columns and f != "turn_index"]
    out = turns.select(*(c for c in turns.columns if c != "_t"), *(F.col(f"_t.{f}").alias(f) for f in plain))
    return out.withColumns({"follow_pos": F.col("turn_index") - start + 1, "is_last": F.col("turn_index") == F.col("chain_length") - 1})


def context(turns: DataFrame, with_answers: bool = True) -> DataFrame:
    """Adds ``messages``: role and content of all turns before, then the question; without answers only the questions."""
    w = Window.partitionBy("chain_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, -1)
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    asked = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")))
    before = F.flatten(F.collect_list(said if with_answers else asked).over(w))
    return turns.withColumn("messages", F.concat(before, asked))


def prompt(messages: Column | str, system: str = "") -> Column:
    """Plain prompt: lines by role, ending with the mark of the answer to come."""
    m = F.col(messages) if isinstance(messages, str) else messages
    lines = F.transform(m, lambda x: F.concat(F.when(x["role"] == "user", USER).when(x["role"] == "assistant", ASSISTANT).otherwise(""), x["content"]))
    return F.concat(F.lit(system + "\n" if system else ""), F.array_join(lines, "\n"), F.lit("\n" + ASSISTANT.rstrip()))


def alternates(messages: Column | str) -> Column:
    """Whether roles (system left out) begin with the user and alternate, so that a chat template fits."""
    m = F.filter(F.col(messages) if isinstance(messages, str) else messages, lambda x: x["role"] != "system")
    return F.forall(F.transform(m, lambda x, i: F.struct(x["role"].alias("r"), i.alias("i"))), lambda x: x["r"] == F.when(x["i"] % 2 == 0, "user").otherwise("assistant"))


def present_answer(present: Column, by_pid: Column, pid: Column) -> Column:
    """Present answer of a chain that has it as text or as a map by property: text, else the map's own entry, else its only one."""
    only = F.when(F.size(by_pid) == 1, F.element_at(F.map_values(by_pid), 1))
    return F.coalesce(present, F.try_element_at(by_pid, pid), only)


def generate_predictions(prompts: DataFrame, generate: Callable[[list[str]], list[list[str]]], batch: int = 16, k: int = 1) -> DataFrame:
    """``prompts`` with ``preds``, the k best texts of the injected generator, called on ``batch`` prompts at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["prompt"].tolist()
            got = [p[:k] for i in range(0, len(texts), batch) for p in generate(texts[i : i + batch])]
            yield part.assign(preds=pd.Series(got, index=part.index, dtype=object))

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField("preds", T.ArrayType(T.StringType()))]))


def answer_in_turn(turns: DataFrame, generate: Callable[[list[str]], list[list[str]]], system: str = "") -> DataFrame:
    """chain_id, turn_index, preds where each prompt holds the generator's own earlier answers.

    A chain is one row with its turns in order; of all chains of an Arrow batch the first turns go to the generator together, then the second ones, and so on.
    """
    plain = turns.select("chain_id", "turn_index", "question")
    told = plain.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", "question"))).alias("turns"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            chains = [(c, list(t), [system] if system else []) for c, t in zip(part["chain_id"], part["turns"], strict=True)]
            out = []
            for i in range(max((len(t) for _, t, _ in chains), default=0)):
                now = [x for x in chains if len(x[1]) > i]
                for _, t, lines in now:
                    lines.append(USER + t[i]["question"])
                for (chain, t, lines), best in zip(now, generate(["\n".join([*lines, ASSISTANT.rstrip()]) for _, _, lines in now]), strict=True):
                    out.append((chain, t[i]["turn_index"], best[:1]))
                    lines.append(ASSISTANT + (best[0] if best else ""))
            yield pd.DataFrame(out, columns=["chain_id", "turn_index", "preds"])

    return told.mapInPandas(run, T.StructType([plain.schema["chain_id"], plain.schema["turn_index"], T.StructField("preds", T.ArrayType(T.StringType()))]))


def score(turns: DataFrame, mode: str = "relaxed", semantic: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Adds correct1, correctk, has_present, drift1, driftk and the error label of each turn with ``answer``, ``preds``, ``present_day_answer``."""
    ready = turns.withColumns(
        {
            "pred": F.coalesce(F.try_element_at("preds", F.lit(1)), F.lit("")),
            "_ready": F.coalesce(F.transform("preds", prepared), F.array()),
            "_gold": F.struct(match_key("answer").alias("key"), normalize("answer").alias("plain")),
            "_now": F.struct(match_key("present_day_answer").alias("key"), normalize("present_day_answer").alias("plain")),
            "has_present": F.coalesce(F.col("present_day_answer") != "", F.lit(False)),
        }
    )
    near = lambda preds, gold: F.exists(preds, lambda p: semantic(p, F.col(gold))) if semantic else F.lit(False)
    hit = lambda n, to, gold: F.exists(F.slice("_ready", 1, n), lambda r: meets(r, F.col(f"{to}.key"), F.col(f"{to}.plain"), mode)) | near(F.slice("preds", 1, n), gold)
    every = 1 << 30
    out = ready.withColumns({"correct1": hit(1, "_gold", "answer"), "correctk": hit(every, "_gold", "answer")})
    drifts = lambda ok, n: F.col("has_present") & ~F.col(ok) & F.coalesce(hit(n, "_now", "present_day_answer"), F.lit(False))
    out = out.withColumns({"drift1": drifts("correct1", 1), "driftk": drifts("correctk", every)}).drop("_ready", "_gold", "_now")
    label = F.when(F.col("correct1"), "correct").when(F.col("drift1"), "drift").when(~F.col("has_present"), "hallucination").otherwise("wrong_answer")
    return out.withColumn("error_label", label)


_COUNTS = ["tok_tp", "tok_pred", "tok_gold", "chr_tp", "chr_pred", "chr_gold"]


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in _COUNTS]))
def _overlaps(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """Counts of words and of three-character grams of two match keys, and of those they share; each distinct key is cut once a batch."""
    grams = lambda s: Counter([s[i : i + 3] for i in range(max(1, len(s) - 2))] if s else ())
    cut = {k: (Counter(k.split()), grams(k.replace(" ", ""))) for k in {*pred, *gold}}
    both = {}
    for p, g in zip(pred, gold, strict=True):
        if (p, g) not in both:
            (tp, cp), (tg, cg) = cut[p], cut[g]
            both[p, g] = ((tp & tg).total(), tp.total(), tg.total(), (cp & cg).total(), cp.total(), cg.total())
    return pd.DataFrame([both[x] for x in zip(pred, gold, strict=True)], columns=_COUNTS, dtype="int32")


def overlaps(scored: DataFrame) -> DataFrame:
    """Adds token and three-character counts of the overlap of prediction and gold answer; texts are normalised once, in one column each."""
    keyed = scored.withColumn("_o", _overlaps(match_key("pred"), match_key("answer")))
    return keyed.select(*scored.columns, "_o.*")


def ratio(a: Column, b: Column) -> Column:
    return F.round(a.cast("double") / F.greatest(F.lit(1), b), 6)


def micro_f1(tp: Column, pred: Column, gold: Column) -> Column:
    p, r = tp.cast("double") / F.greatest(F.lit(1), pred), tp.cast("double") / F.greatest(F.lit(1), gold)
    return F.round(F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0), 6)


def _n(flag: str) -> Column:
    return F.sum(F.col(flag).cast("bigint"))


def turn_metrics(scored: DataFrame) -> DataFrame:
    """Metrics over all turns, by family, by chain length and by follow-up position, from one pass over grouping sets."""
    sums = {"n_turns": F.count(F.lit(1)), "n_ok1": _n("correct1"), "n_okk": _n("correctk"), "n_present": _n("has_present"), "n_drift1": _n("drift1"), "n_driftk": _n("driftk")}
    sums |= {c: F.sum(F.col(c).cast("bigint")) for c in ("tok_tp", "tok_pred", "tok_gold", "chr_tp", "chr_pred", "chr_gold")}
    sets = scored.groupingSets([[], ["family"], ["chain_length"], ["follow_pos"]], "family", "chain_length", "follow_pos").agg(F.grouping_id().alias("_g"), *(v.alias(k) for k, v in sums.items()))
    grouping = F.when(F.col("_g") == 7, "overall").when(F.col("_g") == 3, "family").when(F.col("_g") == 5, "chain_length").otherwise("follow_pos")
    name = F.coalesce("family", F.col("chain_length").cast("string"), F.col("follow_pos").cast("string"), F.lit("all"))
    c = F.col
    return sets.select(
        grouping.alias("grouping"),
        name.alias("bucket"),
        "n_turns",
        ratio(c("n_ok1"), c("n_turns")).alias("acc1"),
        ratio(c("n_okk"), c("n_turns")).alias("acck"),
        ratio(c("n_drift1"), c("n_present")).alias("drift1_rate"),
        ratio(c("n_driftk"), c("n_present")).alias("driftk_rate"),
        ratio(c("n_drift1"), c("n_turns") - c("n_ok1")).alias("drift_of_errors"),
        ratio(c("n_present"), c("n_turns")).alias("present_rate"),
        micro_f1(c("tok_tp"), c("tok_pred"), c("tok_gold")).alias("token_f1"),
        micro_f1(c("chr_tp"), c("chr_pred"), c("chr_gold")).alias("char3_f1"),
    )


def chain_metrics(scored: DataFrame) -> DataFrame:
    """Strict, mean and final-turn accuracy over all chains, by family and by chain length."""
    chains = scored.groupBy("chain_id", "family", "chain_length").agg(
        F.avg(F.col("correct1").cast("double")).alias("_mean"), F.min(F.col("correct1").cast("int")).alias("_strict"), F.max((F.col("is_last") & F.col("correct1")).cast("int")).alias("_final1"), F.max((F.col("is_last") & F.col("correctk")).cast("int")).alias("_finalk")
    )
    sets = chains.groupingSets([[], ["family"], ["chain_length"]], "family", "chain_length").agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n_chains"), *(F.round(F.avg(x), 6).alias(n) for x, n in (("_strict", "strict_acc"), ("_mean", "mean_turn_acc"), ("_final1", "final_acc1"), ("_finalk", "final_acck"))))
    grouping = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "family").otherwise("chain_length")
    return sets.select(grouping.alias("grouping"), F.coalesce("family", F.col("chain_length").cast("string"), F.lit("all")).alias("bucket"), "n_chains", "strict_acc", "mean_turn_acc", "final_acc1", "final_acck")


def examples(scored: DataFrame, most: int = 60, order: Sequence[str] = ("chain_id", "turn_index")) -> DataFrame:
    """The first ``most`` errors and ``most`` // 4 hits in the order of turns."""
    w = Window.partitionBy(F.col("correct1")).orderBy(*order)
    limit = F.when(F.col("correct1"), most // 4).otherwise(most)
    return scored.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).filter(F.col("_rn") <= limit).drop("_rn")
