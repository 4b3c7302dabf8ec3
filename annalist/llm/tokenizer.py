"""Encoding of whole texts with a public byte-level BPE vocabulary, by a two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern. Tier one: a minimal perfect hash over the vocabulary tells in one
probe and one comparison whether a whole pre-token is a token. Tier two, for the rest: the bytes of the pre-token form a
linked list, the mergeable neighbours a heap by rank; merging takes O(n log n) for a pre-token of n bytes, so a run of a million
letters is no trouble. Each distinct pre-token is encoded once for a worker and batch.

The hash is built once on the driver from a vocabulary file (its path is a parameter) and broadcast: a few MB, bounded by
the vocabulary, whatever the corpus.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder of the public vocabularies where the caller names none.
FOLDER = os.environ.get("ANNALIST_TOKENIZERS", "/opt/tokenizers")
#: Pattern of the pre-tokens that goes with the byte-level rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens that a worker remembers, and ids in one outgoing batch; both only bound memory.
REMEMBERED, IDS_A_BATCH = 200_000, 1_000_000


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: n keys, n slots, one displacement for each small bucket.

    Buckets of several keys search for a displacement that puts all of them on free slots, largest buckets first; a bucket of
    one key stores the free slot itself, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = r = max(1, n // 3)
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for k in keys:
            h = xxhash.xxh3_64_intdigest(k)
            groups.setdefault(h % r, []).append((h, k))
        self.shift = [0] * r
        self.keys: list[bytes | None] = [None] * n
        slots = self.keys
        for b, group in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(group) == 1:
                break
            d = 1
            while True:
                at = [self._slot(h, d) for h, _ in group]
                if len(set(at)) == len(at) and all(slots[i] is None for i in at):
                    break
                d += 1
            self.shift[b] = d
            for i, (_, k) in zip(at, group, strict=True):
                slots[i] = k
        free = iter([i for i, k in enumerate(slots) if k is None])
        for b, group in groups.items():
            if len(group) == 1:
                i = next(free)
                slots[i] = group[0][1]
                self.shift[b] = -1 - i

    def _slot(self, h: int, d: int) -> int:
        """Place number d of a hash: multiplied anew for each d, so that keys of one bucket part ways."""
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        return ((x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 24) % self.n

    def find(self, key: bytes) -> int:
        """Slot of the key, -1 if it is none of the keys."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        i = -1 - d if d < 0 else self._slot(h, d)
        return i if self.keys[i] == key else -1


class Vocabulary:
    """Ranks of a byte-level BPE behind a perfect hash; ``encode`` gives the ids of a text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.hash = PerfectHash(list(ranks))
        self.ids = [ranks[k] for k in self.hash.keys]
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.tokens = dict(zip(ranks.values(), ranks, strict=True))
        self.pattern = pattern
        self._start()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_split", "_known", "_pairs")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _start(self) -> None:
        self._split = regex.compile(self.pattern).findall
        self._known = _Memory(self)
        self._pairs: dict[tuple[int, int], int] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a rank file: one token in base 64 and its rank on each line."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def token_id(self, token: bytes) -> int:
        i = self.hash.find(token)
        return -1 if i < 0 else self.ids[i]

    def pre_token_ids(self, token: bytes) -> list[int]:
        whole = self.token_id(token)
        return [whole] if whole >= 0 else self.merge(token)

    def merge(self, token: bytes) -> list[int]:
        """Ids of a byte string by merges of lowest rank first, leftmost among equals."""
        n = len(token)
        ids = [self.byte_ids[b] for b in token]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, heap = self._pairs, []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                pair = (ids[i], ids[j])
                new = pairs.get(pair)
                if new is None:
                    new = pairs[pair] = self.token_id(self.tokens[pair[0]] + self.tokens[pair[1]])
                if new >= 0:
                    heapq.heappush(heap, (new, i, pair[0], pair[1]))

        if len(pairs) > REMEMBERED:
            pairs.clear()
        for i in range(n - 1):
            offer(i)
        while heap:
            new, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        self._known.shrink()
        return list(chain.from_iterable(map(self._known.__getitem__, self._split(text))))

    def count(self, text: str) -> int:
        self._known.shrink()
        return sum(map(len, map(self._known.__getitem__, self._split(text))))


class _Memory(dict):
    """Ids by pre-token; an unknown one is encoded when asked for."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, token: str):
        got = self[token] = tuple(self.vocabulary.pre_token_ids(token.encode()))
        return got

    def shrink(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()


def load_broadcast(df: DataFrame, vocabulary: str, folder: str | None = None):
    """The vocabulary of a rank file as a broadcast variable; its size is that of the file, which is checked."""
    path = vocabulary if os.path.isabs(vocabulary) else os.path.join(folder or FOLDER, vocabulary)
    if os.path.getsize(path) > 64 << 20:
        raise ValueError(f"{path} is larger than a vocabulary may be")
    return df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))


def encode(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """key and ``ids`` (array of INT) of each row, without special tokens; their strings in a text are ordinary text.

    Null and empty texts have an empty list. Blank texts are encoded as they are. One row a row of the input, repeated
    keys included; other columns are left out. An empty table gives no rows.
    """
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    known = load_broadcast(df, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = known.value
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            first, flat, ends = 0, array("i"), [0]
            for i in range(len(texts)):
                t = texts[i].as_py()
                if t:
                    flat.extend(voc.encode(t))
                ends.append(len(flat))
                if len(flat) >= IDS_A_BATCH or i == len(texts) - 1:
                    values = pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, np.int32))
                    items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([keys.slice(first, i + 1 - first), items], names=[key, "ids"])
                    first, flat, ends = i + 1, array("i"), [0]

    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None, column: str = "n_tokens") -> DataFrame:
    """``df`` without ``text`` but with ``column`` (BIGINT), the number of tokens of the text; 0 for null and empty texts."""
    rest = [c for c in df.columns if c not in (text, column)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(column, T.LongType(), False)])
    known = load_broadcast(df, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = known.value
        for batch in batches:
            sizes = [voc.count(t) if t else 0 for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), pa.array(sizes, pa.int64())], names=[*rest, column])

    return df.select(*rest, text).mapInArrow(run, schema)
