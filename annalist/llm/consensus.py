"""Best representative of each duplicate group, by token-level consensus.

The distinct values of a group are aligned progressively, heaviest first: each joins the columns that are there or opens new ones, which
gives the group's skeleton of columns. Then every value is aligned to the skeleton and its tokens vote in their columns by weight,
the winners make the consensus, and the value that survives is the existing one closest to it.

A value is a text, cut into tokens, or a record, an array of fields each of which is a token of its own kind: tokens align with their
kind only, a null field has no vote, and of a record's leading field only the rows of the winner vote on the others, as rows
that speak of something else have no say in its details. Weights add up, or, where some rows are to be trusted over
any number of others, are an order (``dominant``): then a token's vote is that of the best row behind it.

Repeats are combined before the shuffle, so a group is as large as its distinct values. Up to ``CHUNK`` of them are one chunk, aligned in one
go. A larger group has several chunks, spread by hash over tasks, whose skeletons are aligned with each other, again at most ``CHUNK`` at a
time; its votes are counted by (group, column, token) and its distances taken value by value, so that no task ever holds it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint

#: Distinct values or skeletons that are aligned in one go, and tokens of a skeleton's column that later ones are compared with.
CHUNK, SHOWN = 512, 64
#: Cells up to which an alignment keeps its whole table; beyond, the same least number of edits is found in linear space.
CELLS = 1_000_000


def tokens_of(value: str) -> list[str]:
    """Tokens of a value: blanks part words, hyphens and colons the parts of a date or time."""
    out, word = [], ""
    for c in value:
        if c.isspace() or c in "-:/":
            if word:
                out.append(word)
            word = ""
            if not c.isspace():
                out.append(c)
        else:
            word += c
    return [*out, word] if word else out


def _last_row(g: list, v: list, equal: Callable) -> list[int]:
    row = list(range(len(v) + 1))
    for i, x in enumerate(g, 1):
        last, row = row, [i]
        for j, y in enumerate(v, 1):
            row.append(min(last[j - 1] + (not equal(x, y)), last[j] + 1, row[-1] + 1))
    return row


def _table(g: list, v: list, equal: Callable) -> list[tuple[int | None, int | None]]:
    cost = [list(range(len(v) + 1))]
    for i, x in enumerate(g, 1):
        row, last = [i], cost[-1]
        for j, y in enumerate(v, 1):
            row.append(min(last[j - 1] + (not equal(x, y)), last[j] + 1, row[-1] + 1))
        cost.append(row)
    i, j, out = len(g), len(v), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (not equal(g[i - 1], v[j - 1])):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def pairs(guide: Sequence, value: Sequence, equal: Callable = lambda a, b: a == b) -> list[tuple[int | None, int | None]]:
    """Alignment of two lists as (place in guide, place in value), None for a gap; least number of edits, at any length."""
    work, out = [(0, len(guide), 0, len(value))], []
    while work:  # the ranges still to be aligned, leftmost last
        a, b, c, d = work.pop()
        while a < b and c < d and equal(guide[a], value[c]):
            out.append((a, c))
            a, c = a + 1, c + 1
        tail = 0
        while a < b - tail and c < d - tail and equal(guide[b - 1 - tail], value[d - 1 - tail]):
            tail += 1
        if tail:
            work.append((b - tail, b, d - tail, d))
            b, d = b - tail, d - tail
        g, v = guide[a:b], value[c:d]
        if len(g) < 2 or len(g) * len(v) <= CELLS:
            out += [(None if i is None else a + i, None if j is None else c + j) for i, j in _table(g, v, equal)]
        else:  # halve the guide where both halves together need the fewest edits
            half = len(g) // 2
            left, right = _last_row(g[:half], v, equal), _last_row(g[half:][::-1], v[::-1], equal)[::-1]
            cut = min(range(len(v) + 1), key=lambda j: left[j] + right[j])
            work += [(a + half, b, c + cut, d), (a, a + half, c, c + cut)]
    return out


def _in(column: dict, token: str) -> bool:
    return token in column


def _meet(column: dict, other: dict) -> bool:
    return not column.keys().isdisjoint(other)


def join_columns(columns: list[dict], others: list[dict]) -> list[dict]:
    """Two skeletons aligned to one: columns of both, weights of tokens added up."""
    out = []
    for a, b in pairs(columns, others, _meet):
        if a is None or b is None:
            out.append(dict(others[b] if a is None else columns[a]))
        else:
            out.append({t: columns[a].get(t, 0) + others[b].get(t, 0) for t in {**columns[a], **others[b]}})
    return out


def skeleton(values: Sequence[tuple[Sequence[str], float]]) -> list[dict]:
    """Columns of token lists, given heaviest first, by progressive alignment; a column is its tokens with their weights."""
    columns: list[dict] = []
    for tokens, weight in values:
        if len(columns) == len(tokens) and all(t in c for c, t in zip(columns, tokens)):
            for c, t in zip(columns, tokens):
                c[t] += weight
        else:
            columns = join_columns(columns, [{t: weight} for t in tokens])
    return columns


def shown(columns: list[dict]) -> list[dict]:
    """A skeleton as it is passed on: the heaviest tokens of each column, enough to find one's place."""
    return [c if len(c) <= SHOWN else dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:SHOWN]) for c in columns]


def placed(columns: list[dict], tokens: Sequence[str]) -> list[str]:
    """The token that a value has in each column, empty for a gap; one that finds no column has no vote."""
    if len(columns) == len(tokens) and all(t in c for c, t in zip(columns, tokens)):
        return list(tokens)
    out = [""] * len(columns)
    for a, b in pairs(columns, tokens, _in):
        if a is not None and b is not None:
            out[a] = tokens[b]
    return out


def distance(consensus: Sequence[str], tokens: Sequence[str]) -> int:
    """Number of token edits between a consensus and a value."""
    return sum(a is None or b is None or consensus[a] != tokens[b] for a, b in pairs(consensus, tokens))


def winner(votes: dict[str, float]) -> str:
    """Token of most weight, of several the smallest."""
    return min(votes, key=lambda t: (-votes[t], t))


def agree_texts(values: list[tuple[str, int]], dominant: bool = False) -> tuple[list[str], int]:
    """(consensus, place of the survivor) of distinct texts with weights, heaviest first and of equal weights the smallest first."""
    tokens = [tokens_of(v) for v, _ in values]
    columns = shown(skeleton([(t, w) for t, (_, w) in zip(tokens, values)]))
    votes: list[dict] = [{} for _ in columns]
    for t, (_, w) in zip(tokens, values):
        for box, x in zip(votes, placed(columns, t)):
            box[x] = max(w, box.get(x, w)) if dominant else box.get(x, 0) + w
    line = [t for t in map(winner, votes) if t]
    return line, min(range(len(values)), key=lambda i: (distance(line, tokens[i]), i))


def agree_records(values: list[tuple[Sequence[str | None], int]], dominant: bool = False) -> tuple[list[str | None], int]:
    """The same of records. Their columns are their fields; nearer is who differs from the consensus in a later field."""
    line: list[str | None] = []
    voters = values
    for k in range(len(values[0][0])):
        votes: dict = {}
        for v, w in voters:
            if v[k] is not None:
                votes[v[k]] = max(w, votes.get(v[k], w)) if dominant else votes.get(v[k], 0) + w
        line.append(winner(votes) if votes else None)
        if not k:
            voters = [x for x in values if x[0][0] == line[0]]
    return line, min(range(len(values)), key=lambda i: ([a != b for a, b in zip(line, values[i][0])], i))


def _rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of equal keys of sorted batches."""
    now, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for key, row in zip(zip(*columns[:keys], strict=True), zip(*columns[keys:], strict=True), strict=True):
            if key != now and rows:
                yield now, rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield now, rows


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema)], schema=schema)


def _mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(run(parts), to_arrow_schema(schema))

    return df.mapInArrow(batches, schema)


def consensus(df: DataFrame, group: Sequence[str], value: str, weight: str | Column, dominant: bool = False, chunk: int = CHUNK) -> DataFrame:
    """group, ``value`` (the survivor), ``consensus`` (its tokens; of records its fields), ``n_rows``, ``n_values``, ``distance`` (token edits, or fields that differ).

    ``value`` is a text or an array of texts; null values have no vote and a group of nulls only has no row. Nulls in the group columns are a
    group of their own. ``weight`` is a whole number; its sum counts, or with ``dominant`` its maximum. Ties: of tokens the smallest,
    of values at one distance the one of greater weight, then the smallest. Empty texts are values without tokens. Other columns
    are ignored; an empty table gives no rows.
    """
    group = list(group)
    records = isinstance(df.schema[value].dataType, T.ArrayType)
    agree = agree_records if records else agree_texts
    total = F.max if dominant else F.sum
    given = df.select(*group, F.col(value).alias("_value"), (F.col(weight) if isinstance(weight, str) else weight).cast("bigint").alias("_w")).filter(F.col("_value").isNotNull())
    vals = checkpoint(given.groupBy(*group, "_value").agg(total("_w").alias("_w"), F.count(F.lit(1)).alias("_n")))
    many = checkpoint(vals.groupBy(*group).agg(F.count(F.lit(1)).alias("n_values"), F.sum("_n").alias("n_rows")).filter(F.col("n_values") > chunk))
    schema = T.StructType([*vals.select(*group, F.col("_value").alias("value")).schema.fields, *(T.StructField(n, t) for n, t in (("consensus", T.ArrayType(T.StringType())), ("n_rows", T.LongType()), ("n_values", T.LongType()), ("distance", T.IntegerType())))])
    keys, hot = len(group), not many.isEmpty()

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, rows in _rows(parts, keys):
            n = sum(r[2] for r in rows)
            if len(rows) == 1:
                v = rows[0][0]
                yield (*key, v, v if records else tokens_of(v), n, 1, 0)
                continue
            line, k = agree([r[:2] for r in rows], dominant)
            v = rows[k][0]
            yield (*key, v, line, n, len(rows), sum(a != b for a, b in zip(line, v)) if records else distance(line, tokens_of(v)))

    order = [*group, F.desc("_w"), "_value"]
    usual = _beside(vals, many, group, "left_anti") if hot else vals
    found = _mapped(usual.repartition(*(F.col(g) for g in group)).sortWithinPartitions(*order), whole, schema)
    return found.unionByName(_many(_beside(vals, many, group), group, records, dominant, chunk, schema)) if hot else found


def _many(vals: DataFrame, group: list[str], records: bool, dominant: bool, chunk: int, schema: T.StructType) -> DataFrame:
    """The same for groups of more than ``chunk`` values, ``vals`` having n_values and n_rows of the group beside each."""
    keys, total, weigh = len(group), F.max if dominant else F.sum, max if dominant else sum
    text = T.StructField("columns", T.StringType())
    fields = vals.select(*group).schema.fields
    if records:
        places = vals.select(*group, "_w", F.col("_value")[0].alias("_lead"), F.posexplode("_value").alias("_c", "_t")).filter(F.col("_t").isNotNull())
        lead = places.filter("_c = 0").groupBy(*group, "_t").agg(total("_w").alias("_w")).groupBy(*group).agg(F.min(F.struct((-F.col("_w")).alias("w"), F.col("_t").alias("t")))["t"].alias("_first"))
        votes = _beside(places, lead, group).filter((F.col("_c") == 0) | (F.col("_lead") == F.col("_first")))
        width = vals.groupBy(*group).agg(F.max(F.size("_value")).alias("_width"))
    else:
        slots = vals.withColumn("_k", F.pmod(F.xxhash64("_value"), F.ceil(F.col("n_values") / chunk)))

        def first(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for key, rows in _rows(parts, keys + 1):
                made = shown(skeleton([(tokens_of(v), w) for v, w in rows]))
                yield (*key, json.dumps(made), weigh(w for _, w in rows))

        def merged(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for key, rows in _rows(parts, keys + 1):
                out: list[dict] = []
                for columns, _ in rows:
                    out = join_columns(out, json.loads(columns))
                yield (*key, json.dumps(shown(out)), weigh(w for _, w in rows))

        made = T.StructType([*fields, T.StructField("_k", T.LongType()), text, T.StructField("_w", T.LongType())])
        near = lambda d, *c: d.select(*group, "_k", *c).repartition(*(F.col(g) for g in group), "_k")
        skeletons = checkpoint(_mapped(near(slots, "_value", "_w").sortWithinPartitions(*group, "_k", F.desc("_w"), "_value"), first, made))
        while (skeletons.groupBy(*group).count().agg(F.max("count")).first()[0] or 0) > 1:
            fewer = skeletons.withColumn("_k", F.floor(F.col("_k") / chunk).cast("bigint"))
            skeletons = checkpoint(_mapped(near(fewer, "columns", "_w").sortWithinPartitions(*group, "_k", F.desc("_w"), "columns"), merged, made))
        voted = T.StructType([*fields, T.StructField("_w", T.LongType()), T.StructField("_c", T.IntegerType()), T.StructField("_t", T.StringType())])

        def vote(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            known: dict = {}
            for key, rows in _rows(parts, keys):
                for columns, v, w in rows:
                    if columns not in known:
                        known = {columns: json.loads(columns)}
                    for c, t in enumerate(placed(known[columns], tokens_of(v))):
                        yield (*key, w, c, t)

        votes = _mapped(_beside(vals, skeletons.select(*group, "columns"), group).select(*group, "columns", "_value", "_w"), vote, voted)
    counted = votes.groupBy(*group, "_c", "_t").agg(total("_w").alias("_w"))
    chosen = counted.groupBy(*group, "_c").agg(F.min(F.struct((-F.col("_w")).alias("w"), F.col("_t").alias("t")))["t"].alias("_t"))
    line = chosen.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_c", "_t")))).alias("_line"))
    if records:
        line = _beside(line, width, group).select(*group, F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda i: F.try_element_at("_line", i)).alias("consensus"))
    else:
        line = line.select(*group, F.filter(F.map_values("_line"), lambda t: t != "").alias("consensus"))

    measured = T.StructType([*fields, *(T.StructField(n, schema[s].dataType) for n, s in (("_value", "value"), ("consensus", "consensus"))), *(T.StructField(n, T.LongType()) for n in ("_w", "n_rows", "n_values")), T.StructField("_far", T.StringType()), T.StructField("_d", T.IntegerType())])

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, rows in _rows(parts, keys):
            for v, w, n_rows, n_values, line in rows:
                differs = [a != b for a, b in zip(line, v)] if records else None
                d = sum(differs) if records else distance(line, tokens_of(v))
                yield (*key, v, line, w, n_rows, n_values, "".join("01"[x] for x in differs) if records else f"{d:012d}", d)

    texts = _mapped(_beside(vals, line, group).select(*group, "_value", "_w", "n_rows", "n_values", "consensus"), measure, measured)
    first_ = texts.groupBy(*group).agg(F.min(F.struct("_far", (-F.col("_w")).alias("w"), "_value", "consensus", "n_rows", "n_values", "_d")).alias("_f"))
    return first_.select(*group, F.col("_f._value").alias("value"), "_f.consensus", "_f.n_rows", "_f.n_values", F.col("_f._d").alias("distance"))


def _beside(left: DataFrame, right: DataFrame, group: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of the one row of ``right`` for its group; nulls in the group meet nulls."""
    other = right.select(*(F.col(g).alias(f"_g_{g}") for g in group), *(c for c in right.columns if c not in group))
    met = left.join(other, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group], how)
    return met if how == "left_anti" else met.drop(*(f"_g_{g}" for g in group))
