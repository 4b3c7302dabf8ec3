"""SQL fragments of the text functions, questions and adapters, for the oracle queries."""

from __future__ import annotations

from ..functions.dates import sql_day
from ..functions.ids import sql_item, sql_property, sql_rank
from ..schemas import WORDINGS

# Fixed values, written down here once more, so that no error of the engine's own lists is shared by the SQL that checks it.
BAD_LABELS = ["unknown", "unknown value", "none", "null", "n/a", "na", "unspecified", "not known", "not applicable"]
LEADS = ["assistant:", "answer:", "final answer:", "the answer is", "it is", "it's"]
COMPLEMENTS = {
    "P6": "P35", "P35": "P6", "P39": "P102", "P102": "P39", "P108": "P463", "P463": "P108", "P54": "P286", "P286": "P54",
    "P127": "P169", "P169": "P127", "P488": "P169", "P131": "P17", "P17": "P131",
}
TWO_HOPS = [("P108", "P17"), ("P108", "P127"), ("P54", "P17"), ("P131", "P17"), ("P127", "P169"), ("P127", "P749"), ("P31", "P279"), ("P31", "P361")]
COUNTED = ["P108", "P54", "P39", "P463", "P69"]
#: What a property asks for and its meaning.
PROPERTIES = [
    ("P35", "who", "head of state"),
    ("P6", "who", "head of government"),
    ("P169", "who", "chief executive"),
    ("P488", "who", "chairperson"),
    ("P286", "who", "head coach"),
    ("P39", "what", "position held"),
    ("P102", "which", "political party"),
    ("P108", "which", "employer"),
    ("P463", "which", "member of"),
    ("P54", "which", "sports team"),
    ("P69", "which", "educated at"),
    ("P127", "which", "owned by"),
    ("P17", "which", "country"),
    ("P131", "where", "administrative area"),
    ("P276", "where", "location"),
    ("P31", "what", "instance of"),
    ("P279", "what", "subclass of"),
    ("P106", "what", "occupation"),
    ("P101", "what", "field of work"),
]

Q = "chr(39)"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(COALESCE({x}, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def normalize(x: str) -> str:
    return squeeze(f"lower(translate(COALESCE({x}, ''), '“”‘’', '\"\"'''''))")


EDGE = "[!-/:-@\\[-`{-~ ]+"


def strip_edges(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{EDGE}', ''), '{EDGE}$', '')"


def first_line(x: str) -> str:
    return f"split_part(regexp_replace(COALESCE({x}, ''), '^[\\s\\p{{Z}}]+', ''), chr(10), 1)"


def clean_prediction(x: str) -> str:
    leads = "|".join(LEADS).replace("'", "''")
    return strip_edges(f"regexp_replace({squeeze(first_line(x))}, '(?i)^(?:{leads})[ :\\t]*', '')")


def match_key(x: str) -> str:
    return squeeze(f"regexp_replace({normalize(clean_prediction(x))}, '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', '', 'g')")


def candidate_parts(x: str) -> list[str]:
    line = first_line(x)
    tail = f"regexp_extract({line}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])answer:[\\s\\p{{Z}}]*(.*)$', 1)"
    whole = strip_edges(squeeze(f"CASE WHEN {tail} <> '' THEN {tail} ELSE {line} END"))
    return [whole, squeeze(f"regexp_replace({whole}, '\\([^)]*\\)', '', 'g')"), squeeze(f"split_part({whole}, ',', 1)")]


def relaxed(p: str, g: str) -> str:
    k, h = match_key(p), match_key(g)
    parts = f"list_transform(string_split_regex({clean_prediction(p)}, '[,;/|]'), lambda z: {match_key('z')})"
    return f"({k} <> '' AND {h} <> '' AND ({k} = {h} OR contains({k}, {h}) OR contains({h}, {k}) OR list_contains({parts}, {h})))"


def is_match(p: str, g: str) -> str:
    return "(" + " OR ".join(relaxed(c, g) for c in candidate_parts(p)) + ")"


def clean_label(x: str) -> str:
    bad = ", ".join(map(text, BAD_LABELS))
    t = f"lower({squeeze(x)})"
    return f"({x} IS NOT NULL AND length({x}) >= 2 AND {t} NOT IN ({bad}) AND NOT regexp_matches({t}, '^(?:unknown|none|null) ') AND regexp_full_match({x}, '[A-Za-z0-9\\s\\p{{Z}}\\-''.]{{2,100}}'))"


def placeholder(a: str) -> str:
    return f"({squeeze(a)} = '' OR lower({squeeze(a)}) IN ({', '.join(map(text, BAD_LABELS))}) OR regexp_matches(lower({squeeze(a)}), '^(?:unknown|none|null|n/a)'))"


def good_question(q: str, a: str) -> str:
    return f"(length({squeeze(q)}) BETWEEN 10 AND 180 AND length({squeeze(a)}) BETWEEN 2 AND 120 AND NOT {placeholder(a)} AND suffix({squeeze(q)}, '?'))"


def plural(n: str) -> str:
    return f"CASE WHEN suffix({n}, 'y') AND NOT regexp_matches({n}, '[aeiou]y$') THEN left({n}, length({n}) - 1) || 'ies' WHEN suffix({n}, 's') THEN {n} ELSE {n} || 's' END"


def seeded(*parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def coin(percent: int, *parts: str) -> str:
    return f"substr({seeded(*parts)}, 1, 2) < '{round(percent * 256 / 100):02x}'"


def by_pid(pid: str, position: int) -> str:
    return f"CASE {pid} " + " ".join(f"WHEN '{p[0]}' THEN '{p[position]}'" for p in PROPERTIES) + " END"


def question(form: str, pid: str, subject: str = "''", year: str = "''", key: str | None = None) -> str:
    def fill(words: str) -> str:
        parts, rest = [], words
        slots = {"{q}": by_pid(pid, 1), "{m}": by_pid(pid, 2), "{s}": subject, "{y}": f"COALESCE(CAST({year} AS VARCHAR), '')"}
        while rest:
            at, slot = min(((rest.find(s), s) for s in slots if s in rest), default=(len(rest), None))
            parts += [text(rest[:at])] if at else []
            parts += [slots[slot]] if slot else []
            rest = rest[at + len(slot) :] if slot else ""
        return "(" + " || ".join(f"({p})" for p in parts) + ")"

    first, second = WORDINGS[form]
    return f"CASE WHEN {coin(50, text(form), pid, key or pid)} THEN {fill(first)} ELSE {fill(second)} END"


def explicit(a: str = "a") -> str:
    pid, s = f"{a}.pid", f"{a}.subject_label"
    return f"CASE WHEN {a}.truth_type = 'timeless' THEN {question('explicit_timeless', pid, s, key=s)} ELSE {question('explicit_temporal', pid, s, f'{a}.snapshot_year', s)} END"


def complement(pid: str) -> str:
    return f"CASE {pid} " + " ".join(f"WHEN '{p}' THEN '{c}'" for p, c in COMPLEMENTS.items()) + " END"


HOP_RULES = ", ".join(f"('{a}', '{b}')" for a, b in TWO_HOPS)


def days(texts: str, pick: str) -> str:
    return f"list_{pick}(list_filter(list_transform({texts}, lambda x: {sql_day('x')}), lambda d: d IS NOT NULL))"


#: Claims with ids, ranks and days in one form.
BASE = f"""base AS (SELECT snapshot_year, 'Q' || {sql_item('subject_qid')} AS subject_qid, 'P' || {sql_property('pid')} AS pid, 'Q' || {sql_item('value_qid')} AS value_qid, {sql_rank('rank')} AS rank,
  {days('q_start_time', 'min')} AS start_date, {days('q_end_time', 'max')} AS end_date, {days('q_point_in_time', 'min')} AS pit_date, COLUMNS('^q_') FROM claims)"""


def truth(month_days: tuple[str, ...]) -> str:
    anchors = ", ".join(f"('{d}')" for d in month_days)
    return f"""{BASE},
kept AS (SELECT *, CASE WHEN start_date IS NULL AND end_date IS NULL AND pit_date IS NULL THEN 'timeless' ELSE 'temporal' END AS truth_type,
  CASE rank WHEN 'preferred' THEN 2 WHEN 'normal' THEN 1 ELSE 0 END AS rank_score FROM base WHERE rank <> 'deprecated' AND subject_qid <> value_qid),
truth AS (SELECT k.*, CAST(snapshot_year || '-' || d.md AS DATE) AS anchor_date FROM kept k, (VALUES {anchors}) d(md)
  WHERE truth_type = 'timeless' OR CASE WHEN pit_date IS NOT NULL THEN year(pit_date) = snapshot_year
    ELSE (start_date IS NULL OR start_date <= CAST(snapshot_year || '-' || d.md AS DATE)) AND (end_date IS NULL OR end_date >= CAST(snapshot_year || '-' || d.md AS DATE)) END),
best AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY anchor_date, truth_type, subject_qid, pid ORDER BY rank_score DESC, value_qid, start_date NULLS FIRST, end_date NULLS FIRST, pit_date NULLS FIRST, rank) AS n FROM truth) WHERE n = 1)"""


LABELS = f"""lab AS (SELECT id, min(label) AS label FROM (SELECT 'Q' || {sql_item('id')} AS id, label FROM labels WHERE lang = 'en') WHERE id IS NOT NULL AND {clean_label('label')} GROUP BY id)"""

#: All active temporal rows (rich) and the best of each subject and property, with labels.
FACTS = f"""{LABELS},
facts AS (SELECT DISTINCT snapshot_year, anchor_date, 'temporal' AS truth_type, 'Q' || {sql_item('subject_qid')} AS subject_qid, 'P' || {sql_property('pid')} AS pid, 'Q' || {sql_item('value_qid')} AS value_qid,
  CASE lower(trim(rank, ' ' || chr(9) || chr(10) || chr(13))) WHEN 'preferred' THEN 2 WHEN 'normal' THEN 1 WHEN 'deprecated' THEN 0 ELSE COALESCE(rank_score, 1) END AS rank_score, start_date, end_date, pit_date FROM temporal_facts),
fbest AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY anchor_date, subject_qid, pid ORDER BY rank_score DESC, value_qid, start_date NULLS FIRST, end_date NULLS FIRST, pit_date NULLS FIRST) AS n FROM facts) WHERE n = 1),
rich AS (SELECT f.*, s.label AS subject_label, v.label AS value_label, year(COALESCE(pit_date, start_date, end_date)) AS year FROM facts f JOIN lab s ON s.id = f.subject_qid JOIN lab v ON v.id = f.value_qid WHERE f.pid IN ({', '.join(repr(p[0]) for p in PROPERTIES)})),
best AS (SELECT f.*, s.label AS subject_label, v.label AS value_label, year(COALESCE(pit_date, start_date, end_date)) AS year FROM fbest f JOIN lab s ON s.id = f.subject_qid JOIN lab v ON v.id = f.value_qid WHERE f.pid IN ({', '.join(repr(p[0]) for p in PROPERTIES)})),
one AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_year, anchor_date, truth_type, subject_label, pid ORDER BY {seeded("'42'", 'value_qid')}, value_qid, value_label, subject_qid) AS n FROM best) WHERE n = 1)"""
