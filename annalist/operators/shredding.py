"""Deeply nested JSON records as flat tables, by adjacency-table shredding.

A record becomes rows of an adjacency table: node, parent, label, ordinal, kind, scalar. Flat tables come out of it by joins of
object nodes with their scalar children, pivoted to one row an entity. A record lies in one row of the input, so none of these
joins ever crosses a row: they run inside the partition, batch by batch, on the node numbers (an array index is the hash
table), and no shuffle is needed at any scale. ``adjacency`` gives the node table itself, ``entities`` the pivoted tables.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Steps of a path that stand for any label of an object and any element of an array.
ANY, EACH = "*", "[]"


class Number(str):
    """A number as it is written, so that none is too long or loses digits."""


_KINDS = {dict: "object", list: "array", str: "string", bool: "bool", type(None): "null", Number: "number"}
_JSON = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=Number)
_BLANK, _SCALAR = re.compile(r"[ \t\n\r]*"), re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity")
_WORDS = {"true": True, "false": False, "null": None}
#: Lines handled at a time; bounds a worker's memory whatever the size of an Arrow batch.
CHUNK = 1000


def parse_nested(text: str):
    """The JSON value of a text nested to any depth, by a stack of open objects and arrays; ValueError where it is none."""
    skip = lambda i: _BLANK.match(text, i).end()
    done: list = []  # the whole value once it is there
    open_: list[tuple] = []  # (container, its current key)

    def put(x) -> None:
        if not open_:
            done.append(x)
        elif isinstance(open_[-1][0], dict):
            open_[-1][0][open_[-1][1]] = x
        else:
            open_[-1][0].append(x)

    def key(i: int) -> int:
        if text[i : i + 1] != '"':
            raise ValueError("a key must be a string")
        name, i = json.decoder.scanstring(text, i + 1)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("no colon after a key")
        open_[-1] = (open_[-1][0], name)
        return skip(i + 1)

    i, n = skip(0), len(text)
    while not done or open_:
        c = text[i : i + 1]
        if c in ("{", "["):
            box: dict | list = {} if c == "{" else []
            put(box)
            open_.append((box, None))
            i = skip(i + 1)
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                i = key(i) if c == "{" else i
                continue
        elif c == '"':
            x, i = json.decoder.scanstring(text, i + 1)
            put(x)
            i = skip(i)
        else:
            m = _SCALAR.match(text, i)
            if not m:
                raise ValueError("no value")
            put(_WORDS[m.group()] if m.group() in _WORDS else Number(m.group()))
            i = skip(m.end())
        while open_:  # what comes after a value: the end of its container, or a comma and the next one
            box, end = open_[-1][0], text[i : i + 1]
            if end == ("}" if isinstance(box, dict) else "]"):
                open_.pop()
                i = skip(i + 1)
            elif end == ",":
                i = skip(i + 1)
                i = key(i) if isinstance(box, dict) else i
                break
            else:
                raise ValueError("no comma or end")
    if i != n:
        raise ValueError("text after the value")
    return done[0]


def read_line(line: str | None) -> tuple[object, str | None]:
    """The JSON value of a line of a shard or of a raw dump (one trailing comma, blanks and a byte order mark do not count), or the reason why there is none."""
    if line is None:
        return None, "null line"
    text = line.strip(" \t\r\n﻿\x00")
    if text.endswith(","):
        text = text[:-1].rstrip()
    if not text:
        return None, "blank"
    if text in ("[", "]"):
        return None, "bracket of a dump"
    try:
        return _JSON.decode(text), None
    except RecursionError:
        pass
    except ValueError:
        return None, "no JSON"
    try:
        return parse_nested(text), None
    except ValueError:
        return None, "no JSON"


def parse_line(line: str | None):
    """The JSON value of a line, None where there is none (or it is a JSON null)."""
    return read_line(line)[0]


def _array(values: Sequence, kind: pa.DataType) -> pa.Array:
    """An Arrow array; half a surrogate pair, which no text can hold, becomes the replacement character."""
    try:
        return pa.array(values, kind, from_pandas=True)
    except UnicodeEncodeError:
        whole = lambda x: x.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(x, str) else x
        return pa.array([whole(x) for x in values], kind, from_pandas=True)


class Nodes:
    """The adjacency table of some records, by columns; node numbers run on over all of them."""

    def __init__(self, skip: Sequence[str] = ()):
        self.skip = frozenset(skip)
        self.record, self.parent, self.label, self.ordinal, self.kind, self.scalar = [], [], [], [], [], []

    def add(self, record: int, value) -> None:
        """Nodes of one record in document order; subtrees under a label of ``skip`` are left out."""
        rec, par, lab, ordn, kind, sca, skip = self.record, self.parent, self.label, self.ordinal, self.kind, self.scalar, self.skip
        stack = [(value, -1, None, 0)]
        while stack:
            v, p, name, k = stack.pop()
            n = len(par)
            t = _KINDS[type(v)]
            rec.append(record)
            par.append(p)
            lab.append(name)
            ordn.append(k)
            kind.append(t)
            if t == "object":
                sca.append(None)
                stack.extend([(x, n, key, i) for i, (key, x) in enumerate(v.items()) if key not in skip][::-1])
            elif t == "array":
                sca.append(None)
                stack.extend([(x, n, None, i) for i, x in enumerate(v)][::-1])
            else:
                sca.append(v if t == "string" else None if v is None else str(v) if t == "number" else json.dumps(v))

    def freeze(self) -> Nodes:
        codes: dict = {}
        self.labels = np.array(self.label, dtype=object)
        self.codes = np.fromiter((codes.setdefault(x, len(codes)) for x in self.label), np.int32, len(self.label))
        self.code_of = codes
        self.up = np.array(self.parent, dtype=np.int64)
        self.ord = np.array(self.ordinal, dtype=np.int32)
        kinds = {k: i for i, k in enumerate(("object", "array", "string", "number", "bool", "null"))}
        self.kinds = np.fromiter((kinds[k] for k in self.kind), np.int8, len(self.kind))
        self.values = np.array(self.scalar, dtype=object)
        self.records = np.array(self.record, dtype=np.int64)
        return self

    def children(self, mask: np.ndarray, step: str) -> np.ndarray:
        """Join of the nodes in ``mask`` with their children under ``step``."""
        found = (self.up >= 0) & mask[self.up]
        if step == EACH:
            return found & (self.kinds[self.up] == 1)
        found &= self.kinds[self.up] == 0
        return found if step == ANY else found & (self.codes == self.code_of.get(step, -1))

    def at(self, path: Sequence[str], mask: np.ndarray | None = None) -> np.ndarray:
        mask = self.up < 0 if mask is None else mask
        for step in path:
            mask = self.children(mask, step)
        return mask

    def ancestor(self, nodes: np.ndarray, levels: int) -> np.ndarray:
        for _ in range(levels):
            nodes = self.up[nodes]
        return nodes

    def pivot(self, mask: np.ndarray, path: Sequence[str], kinds: Sequence[int] = (2, 3, 4)) -> np.ndarray:
        """Scalar found under ``path`` of each node in ``mask`` (in node order), None where there is none."""
        found = self.at(path, mask) & np.isin(self.kinds, kinds)
        nodes = np.flatnonzero(found)
        out = np.full(len(mask), None, dtype=object)
        out[self.ancestor(nodes, len(path))] = self.values[nodes]
        return out[mask]


def _lines(batch: pa.RecordBatch, key: str, text: str) -> Iterator[tuple[list, list]]:
    keys, lines = batch.column(batch.schema.get_field_index(key)).to_pylist(), batch.column(batch.schema.get_field_index(text)).to_pylist()
    for i in range(0, len(keys), CHUNK):
        yield keys[i : i + CHUNK], lines[i : i + CHUNK]


def adjacency(df: DataFrame, key: str, text: str, skip: Sequence[str] = ()) -> DataFrame:
    """key, ``node``, ``parent``, ``label``, ``ordinal``, ``kind``, ``scalar`` of each JSON line; nodes are numbered from 0 in a line.

    ``parent`` of the root is -1; elements of an array have a null label, scalars are texts. Null, blank and unparsable lines
    and an empty table give no rows.
    """
    schema = T.StructType([df.schema[key], *(T.StructField(n, t) for n, t in (("node", T.IntegerType()), ("parent", T.IntegerType()), ("label", T.StringType()), ("ordinal", T.IntegerType()), ("kind", T.StringType()), ("scalar", T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(batch.schema.get_field_index(key)).type
            for keys, lines in _lines(batch, key, text):
                cols: list[list] = [[] for _ in range(7)]
                for k, line in zip(keys, lines, strict=True):
                    value = parse_line(line)
                    if value is None:
                        continue
                    n = Nodes(skip)
                    n.add(0, value)
                    for c, x in zip(cols, ([k] * len(n.parent), range(len(n.parent)), n.parent, n.label, n.ordinal, n.kind, n.scalar), strict=True):
                        c.extend(x)
                types = (kind, pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([_array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.name for f in schema.fields])

    return df.select(key, text).mapInArrow(run, schema)


def entities(df: DataFrame, key: str, text: str, schema: T.StructType, build: Callable[[Nodes], list[tuple[np.ndarray, list]]], keep: Callable[[object], bool], skip: Sequence[str] = ()) -> DataFrame:
    """key and the columns of ``schema``, one row for each entity that ``build`` pivots out of the adjacency table.

    ``build`` gets the nodes of some records and gives (record number of each row, columns) pairs; ``keep`` tells which parsed lines
    are records at all. Lines that cannot be parsed drop out.
    """
    full = T.StructType([df.schema[key], *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            kind = batch.schema.field(batch.schema.get_field_index(key)).type
            types = [kind, *(to_arrow_type(f.dataType) for f in schema.fields)]
            for keys, lines in _lines(batch, key, text):
                nodes, used = Nodes(skip), []
                for k, line in zip(keys, lines, strict=True):
                    value = parse_line(line)
                    if value is not None and keep(value):
                        nodes.add(len(used), value)
                        used.append(k)
                if not used:
                    continue
                for records, columns in build(nodes.freeze()):
                    yield pa.RecordBatch.from_arrays([_array(c, t) for c, t in zip(([used[r] for r in records], *columns), types, strict=True)], names=full.names)

    return df.select(key, text).mapInArrow(run, full)


# Entity documents: claims and their qualifiers.

SNAK_SCHEMA = T.StructType(
    [T.StructField("pid", T.StringType()), T.StructField("claim_no", T.IntegerType()), T.StructField("qual_pid", T.StringType()), T.StructField("qual_no", T.IntegerType()), T.StructField("snak_value", T.StringType())]
)


def is_item_document(value) -> bool:
    """A JSON object whose id begins with Q."""
    return isinstance(value, dict) and type(value.get("id")) is str and value["id"].startswith("Q")


def _number_of(text: str | None, letter: str) -> str | None:
    t = (text or "").strip()
    return str(int(t[1:])) if t[:1].upper() == letter and t[1:].isascii() and t[1:].isdigit() else None


def snak_values(nodes: Nodes, mask: np.ndarray, below: Sequence[str] = ()) -> list[str]:
    """Value of the snak under ``below`` of each node in ``mask``: item id, time, amount, text or plain string; empty if none."""
    get = lambda *path, kinds=(2, 3, 4): nodes.pivot(mask, [*below, *path], kinds)
    value = ("datavalue", "value")
    snaktype, plain, number, item, kind = get("snaktype"), get(*value, kinds=(2,)), get(*value, "numeric-id"), get(*value, "id"), get(*value, "entity-type")
    time, amount, words = get(*value, "time"), get(*value, "amount"), get(*value, "text")
    out = []
    for i in range(len(snaktype)):
        if snaktype[i] not in (None, "value"):
            out.append("")
        elif plain[i] is not None:
            out.append(plain[i])
        elif kind[i] == "item" or kind[i] is None and (number[i] or item[i]):
            n = str(number[i]) if number[i] and str(number[i]).isdigit() else _number_of(item[i], "Q")
            out.append(f"Q{n}" if n else "")
        else:
            out.append(next((x[i] for x in (time, amount, words) if x[i] is not None), ""))
    return out


def _property_text(labels: np.ndarray) -> list[str]:
    seen: dict = {}
    for x in set(labels):
        n = _number_of(x, "P")
        seen[x] = f"P{n}" if n else x
    return [seen[x] for x in labels]


def _snak_rows(nodes: Nodes) -> list[tuple[np.ndarray, list]]:
    claims = nodes.at(("claims", ANY, EACH)) & (nodes.kinds == 0)
    c = np.flatnonzero(claims)
    quals = nodes.at(("qualifiers", ANY, EACH), claims) & (nodes.kinds == 0)
    q = np.flatnonzero(quals)
    owner = nodes.ancestor(q, 3)
    pid = lambda x: _property_text(nodes.labels[nodes.up[x]])
    return [
        (nodes.records[c], [pid(c), nodes.ord[c], [""] * len(c), np.full(len(c), -1, np.int32), snak_values(nodes, claims, ("mainsnak",))]),
        (nodes.records[q], [pid(owner), nodes.ord[owner], pid(q), nodes.ord[q], snak_values(nodes, quals)]),
    ]


def claim_snaks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ``pid``, ``claim_no``, ``qual_pid``, ``qual_no``, ``snak_value`` of the claims and qualifiers of entity documents.

    A claim has an empty ``qual_pid`` and ``qual_no`` -1; a qualifier has those of its place and is tied to its claim by
    (key, pid, claim_no). Lines that are null, blank, unparsable or no item document, and documents whose claims are
    missing, null or an empty list give no rows. Repeated lines give their rows each under its own key.
    """
    return entities(df, key, text, SNAK_SCHEMA, _snak_rows, is_item_document, skip=("references", "labels", "descriptions", "aliases", "sitelinks", "qualifiers-order"))


def rejected_lines(df: DataFrame, text: str, keep: Callable[[object], bool] = is_item_document) -> DataFrame:
    """``reason`` and ``n_lines`` of the lines that are no record: null or blank, a bracket of a dump, no JSON, or not what ``keep`` takes."""
    schema = T.StructType([T.StructField("reason", T.StringType()), T.StructField("n_lines", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for line in batch.column(0).to_pylist():
                value, reason = read_line(line)
                if reason or not keep(value):
                    seen[reason or "no record"] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=schema.names)

    return df.select(text).mapInArrow(run, schema).groupBy("reason").agg(F.sum("n_lines").alias("n_lines"))
