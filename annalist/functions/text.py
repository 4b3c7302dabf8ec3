"""Normalisation, matching and quality of short texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BAD_LABELS

#: Explicit classes, so that every engine agrees: what is no letter, digit, underscore or blank; and blanks.
NOT_WORD, BLANK = r"[^\p{L}\p{N}_\s\p{Z}]", r"[\s\p{Z}]+"
#: ASCII punctuation and the blank, stripped from the edges of an answer.
EDGE = r"[!-/:-@\[-`{-~ ]+"
#: Lead-ins that a prediction may start with, in order of precedence.
LEADS = ["assistant:", "answer:", "final answer:", "the answer is", "it is", "it's"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(text: Column | str) -> Column:
    """Blanks collapsed to one and cut off at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), BLANK, " "))


def normalize(text: Column | str) -> Column:
    """Straight quotes, lower case, single blanks; null becomes empty."""
    t = F.translate(F.coalesce(_c(text), F.lit("")), "“”‘’", "\"\"''")
    return squeeze(F.lower(t))


def strip_edges(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^" + EDGE, ""), EDGE + "$", "")


def first_line(text: Column) -> Column:
    return F.substring_index(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\p{Z}]+", ""), "\n", 1)


def clean_prediction(text: Column | str) -> Column:
    """First line without one lead-in and without punctuation at the edges."""
    t = squeeze(first_line(_c(text)))
    return strip_edges(F.regexp_replace(t, f"(?i)^(?:{'|'.join(LEADS)})[ :\\t]*", ""))


def match_key(text: Column | str) -> Column:
    """Cleaned, lower-case words only."""
    return squeeze(F.regexp_replace(normalize(clean_prediction(text)), NOT_WORD, ""))


def candidate_forms(prediction: Column | str) -> Column:
    """The whole answer, without brackets, and up to the first comma; equal and empty ones included."""
    line = first_line(_c(prediction))
    tail = F.regexp_extract(line, r"(?i)(?:^|[^\p{L}\p{N}_])answer:[\s\p{Z}]*(.*)$", 1)
    whole = strip_edges(squeeze(F.when(tail != "", tail).otherwise(line)))
    return F.array(whole, squeeze(F.regexp_replace(whole, r"\([^)]*\)", "")), squeeze(F.substring_index(whole, ",", 1)))


def candidates(prediction: Column | str) -> Column:
    """Answers a prediction may mean: the whole, without brackets, up to the first comma; equal ones once, in that order."""
    given = F.transform(candidate_forms(prediction), lambda f: F.struct(f.alias("text"), match_key(f).alias("key")))
    once = F.aggregate(given, F.array().cast("array<struct<text:string,key:string>>"), lambda out, x: F.when((x["key"] == "") | F.exists(out, lambda y: y["key"] == x["key"]), out).otherwise(F.array_append(out, x)))
    return F.transform(once, lambda x: x["text"])


def prepared(prediction: Column | str) -> Column:
    """What matching needs of each candidate form: its key, its plain normal form, the keys of its listed parts. Keep it as a column, so that it is made once."""
    parts = lambda f: F.transform(F.split(clean_prediction(f), r"[,;/|]"), match_key)
    return F.transform(candidate_forms(prediction), lambda f: F.struct(match_key(f).alias("key"), normalize(f).alias("plain"), parts(f).alias("parts")))


def meets(ready: Column, gold_key: Column, gold_plain: Column, mode: str = "relaxed") -> Column:
    """Whether any prepared candidate matches the gold answer, given its key and plain normal form; empty candidates never do."""
    if mode == "exact":
        return F.exists(ready, lambda s: (s["key"] != "") & (s["plain"] == gold_plain))
    hit = lambda s: (s["key"] == gold_key) | s["key"].contains(gold_key) | gold_key.contains(s["key"]) | F.array_contains(s["parts"], gold_key)
    return (gold_key != "") & F.exists(ready, lambda s: (s["key"] != "") & hit(s))


def match_exact(prediction: Column | str, gold: Column | str) -> Column:
    return normalize(prediction) == normalize(gold)


def match_relaxed(prediction: Column | str, gold: Column | str) -> Column:
    """Equal, or one within the other, or a part of a list equal to the gold answer, all by ``match_key``; empty never matches."""
    p, g = match_key(prediction), match_key(gold)
    parts = F.transform(F.split(clean_prediction(prediction), r"[,;/|]"), match_key)
    return (p != "") & (g != "") & ((p == g) | p.contains(g) | g.contains(p) | F.array_contains(parts, g))


def is_match(prediction: Column | str, gold: Column | str, mode: str = "relaxed") -> Column:
    """Whether any candidate of the prediction matches the gold answer."""
    return meets(prepared(prediction), match_key(gold), normalize(gold), mode)


def word_tokens(text: Column | str) -> Column:
    key = match_key(text)
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.split(key, " "))


def char_ngrams(text: Column | str, n: int = 3) -> Column:
    """Sliding n-grams of the key without blanks; a shorter key is one gram, an empty one none."""
    key = F.replace(match_key(text), F.lit(" "), F.lit(""))
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(key) - (n - 1))), lambda i: F.substring(key, i, F.lit(n)))
    return F.when(key == "", F.array().cast("array<string>")).when(F.length(key) < n, F.array(key)).otherwise(many)


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays; give columns, not expressions, as each is read for every element."""
    count = lambda xs, t: F.size(F.filter(xs, lambda y: y == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(count(a, t), count(b, t)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product, the cosine of unit vectors."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def plural(noun: Column | str) -> Column:
    n = _c(noun)
    return F.when(n.endswith("y") & ~n.rlike("[aeiou]y$"), F.concat(F.substring(n, F.lit(1), F.length(n) - 1), F.lit("ies"))).when(n.endswith("s"), n).otherwise(F.concat(n, F.lit("s")))


# Quality


def is_clean_label(label: Column | str) -> Column:
    """Two to a hundred ASCII letters, digits, blanks, hyphens, apostrophes and points that say something; null is not clean."""
    t = F.lower(squeeze(label))
    ok = (F.length(_c(label)) >= 2) & ~t.isin(BAD_LABELS) & ~t.rlike("^(?:unknown|none|null) ") & _c(label).rlike(r"^[A-Za-z0-9\s\p{Z}\-'.]{2,100}$")
    return F.coalesce(ok, F.lit(False))


def is_placeholder(answer: Column | str) -> Column:
    t = F.lower(squeeze(answer))
    return (t == "") | t.isin(BAD_LABELS) | t.rlike("^(?:unknown|none|null|n/a)")


def good_question(question: Column | str, answer: Column | str, short_numbers: bool = False) -> Column:
    """Gate of single questions: lengths, no placeholder, a question mark at the end. ``short_numbers`` lets one-digit answers pass."""
    q, a = squeeze(question), squeeze(answer)
    least = F.length(a) >= 2
    if short_numbers:
        least |= a.rlike("^[0-9]$")
    return F.length(q).between(10, 180) & least & (F.length(a) <= 120) & ~is_placeholder(answer) & q.endswith("?")


def good_chain(turns: Column | str) -> Column:
    """Gate of chains: every turn passes, no question twice, and from three turns on not all answers equal."""
    t = _c(turns)
    questions = F.transform(t, lambda x: F.lower(squeeze(x["question"])))
    answers = F.transform(t, lambda x: F.lower(squeeze(x["answer"])))
    return (
        (F.size(t) > 0) & F.forall(t, lambda x: good_question(x["question"], x["answer"])) & (F.size(F.array_distinct(questions)) == F.size(t)) & ((F.size(t) < 3) | (F.size(F.array_distinct(answers)) > 1))
    )


def question_key(question: Column | str) -> Column:
    return F.lower(squeeze(question))


def seeded(*parts: Column | str | int) -> Column:
    """Portable random order: md5 of the parts joined by a bar."""
    return F.md5(F.concat_ws("|", *(F.lit(str(p)) if not isinstance(p, Column) else p.cast("string") for p in parts)))


def coin(percent: int, *parts: Column | str | int) -> Column:
    """Portable chance: true in ``percent`` of 100, by the first two hex digits of ``seeded``."""
    return F.substring(seeded(*parts), 1, 2) < F.lit(f"{round(percent * 256 / 100):02x}")
