"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared if they share a seed, a run of
``SEED`` words.  Their longest common runs of words that overlap no run taken
before are then taken as tiles, longest first (found by Karp-Rabin hashes of a
search length that falls from round to round), down to ``SEED`` words.  An item
counts as leaked when its tiles cover ``THRESHOLD`` of its words, wherever
they stand in the document, so a reordered passage is caught as well.

The benchmark is read in slices of at most ``SLICE`` characters; each slice is
broadcast and the documents stream past it, so neither side is shuffled and
the size of a broadcast is bounded however large the benchmark is.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxomatch.llm.common import member, parts

SEED = 5
THRESHOLD = 0.8
SLICE = 8 << 20

#: A-Z to lower case, ASCII punctuation and controls to blanks; other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32
              for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text: runs of ASCII letters, digits and non-ASCII characters."""
    return (text or "").encode().translate(_FOLD).split()


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2^64) of each run of ``size`` codes."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    c = codes.astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _BASE + c[i : n + i]
    return out


def _scan(p: list, t: list, free_p: list, free_t: list, size: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, start in p, start in t) of at least ``size``
    unmarked words."""
    hp, ht = window_hashes(np.array(p), size).tolist(), window_hashes(np.array(t), size).tolist()
    table: dict[int, list[int]] = {}
    for i, h in enumerate(hp):
        if all(free_p[i : i + size]):
            table.setdefault(h, []).append(i)
    found = []
    for j, h in enumerate(ht):
        for i in table.get(h, ()):
            if i and j and p[i - 1] == t[j - 1] and free_p[i - 1] and free_t[j - 1]:
                continue  # part of a longer run
            n = 0
            while (i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n]
                   and free_p[i + n] and free_t[j + n]):
                n += 1
            if n >= size:
                found.append((n, i, j))
    return found


def tile(p: list, t: list, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, start in p, start in t) of at least ``least`` words."""
    free_p, free_t = [True] * len(p), [True] * len(t)
    size = max(least, min(len(p), len(t), 4 * least))
    tiles = []
    while True:
        found = _scan(p, t, free_p, free_t, size)
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        # Longest first; of a run that a tile has cut, the free parts queue up again.
        queue = [(-n, i, j) for n, i, j in found]
        heapq.heapify(queue)
        while queue:
            n, i, j = heapq.heappop(queue)
            n = -n
            both = [free_p[i + k] and free_t[j + k] for k in range(n)]
            if all(both):
                tiles.append((n, i, j))
                free_p[i : i + n] = free_t[j : j + n] = [False] * n
                continue
            start = None
            for k, free in enumerate([*both, False]):
                if free and start is None:
                    start = k
                elif not free and start is not None:
                    if k - start >= size:
                        heapq.heappush(queue, (start - k, i + start, j + start))
                    start = None
        if size == least:
            return tiles
        size = max(least, size // 2)


class Index:
    """Items of one slice: codes of their words and the places of their seeds."""

    def __init__(self, items: list[tuple], least: int):
        self.least = least
        self.code: dict[bytes, int] = {}
        self.ids, self.items = [], []
        places: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = tokens(text)
            if len(words) < least:
                continue
            codes = np.array([self.code.setdefault(w, len(self.code) + 1) for w in words], np.int64)
            for at, h in enumerate(window_hashes(codes, least).tolist()):
                places.setdefault(h, []).append((len(self.items), at))
            self.ids.append(item_id)
            self.items.append(codes.tolist())
        self.places = places
        self.seeds = np.array(sorted(places), np.uint64)

    def leaks(self, text: str | None, threshold: float) -> list[tuple[int, int, int]]:
        """(item, words covered, tiles) of the items that a text leaks."""
        words = tokens(text)
        if len(words) < self.least or not len(self.seeds):
            return []
        codes = np.fromiter(map(self.code.get, words, repeat(0)), np.int64, len(words))
        # Only runs of words that the benchmark has can be seeds.
        known = np.cumsum(np.concatenate([[0], codes != 0]))
        at = np.nonzero(known[self.least :] - known[: -self.least] == self.least)[0]
        if not len(at):
            return []
        h = np.zeros(len(at), np.uint64)
        for i in range(self.least):
            h = h * _BASE + codes[at + i].astype(np.uint64)
        hit = member(h, self.seeds)
        if not hit.any():
            return []
        starts: dict[int, list[int]] = {}
        covered: dict[int, set[int]] = {}
        for place, seed in zip(at[hit].tolist(), h[hit].tolist()):
            for item, where in self.places[seed]:
                if not starts.setdefault(item, []) or starts[item][-1] != place:
                    starts[item].append(place)
                covered.setdefault(item, set()).update(range(where, where + self.least))
        out = []
        for item, own in covered.items():
            p = self.items[item]
            if len(own) < threshold * len(p):
                continue  # the tiles cannot cover more than the seeds do
            # The text around the item's seeds; -1, -2, ... keep the parts apart.
            t: list[int] = []
            end = gap = 0
            for s in starts[item]:
                if s >= end and t:
                    gap -= 1
                    t.append(gap)
                t += codes[max(s, end) : s + self.least].tolist()
                end = s + self.least
            tiles = tile(p, t, self.least)
            n = sum(x for x, _, _ in tiles)
            if n >= threshold * len(p):
                out.append((item, n, len(tiles)))
        return out


def slices(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", least: int = SEED) -> Iterator[Index]:
    """The benchmark as indexes of a bounded number of characters each (one
    item longer than the bound makes a slice larger)."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").alias("text")).where(
        "text IS NOT NULL")
    total = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    n = -(-total // SLICE)
    for i in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield Index([(r.item, r.text) for r in own.collect()], least)


def leaks(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, coverage, n_tiles.

    Null or empty texts leak nothing; items without a text or under ``SEED``
    words are not tested.  Repeated rows (of either side) give one row per pair,
    the one of largest coverage.  Other columns are not looked at.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = benchmark.schema[item_id].dataType
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", kind)]).add(
        "coverage", "double").add("n_tiles", "long")
    out = spark.createDataFrame([], schema)
    for index in slices(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in parts(batches):
                rows = [(i, *x) for i, t in enumerate(b.column(1).to_pylist()) for x in index.leaks(t, threshold)]
                if rows:
                    place, item, n, tiles = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(place)),
                         pa.array([index.ids[k] for k in item], _arrow(kind)),
                         pa.array([c / len(index.items[k]) for k, c in zip(item, n)], pa.float64()),
                         pa.array(tiles, pa.int64())], names=["doc_id", "item_id", "coverage", "n_tiles"])

        out = out.unionByName(docs.mapInArrow(run, schema))
    best = F.max(F.struct("coverage", "n_tiles"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.coverage", "b.n_tiles")


def without_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that leak no item, with all their columns."""
    spark = df.sparkSession
    place = df.columns.index(text)
    for index in slices(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in parts(batches):
                clean = [not shared.value.leaks(t, threshold) for t in b.column(place).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
