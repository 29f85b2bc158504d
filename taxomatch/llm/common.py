"""Shared helpers of the text operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxomatch.session import materialize

#: White space between words: the bytes that ``bytes.split()`` splits on.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_store(owner: str) -> dict:
    """A dict that lives as long as the Python worker process, or until the
    worker is used with another ``owner``: then all it holds is let go.

    Functions of this package travel by value, so their module globals are new
    in every task; tables that are costly to load (vocabularies) and their memos
    are kept here between the tasks of a stage, and not beside those of others."""
    name = "_taxomatch_worker_store"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if store.get("owner") != owner:
        store.clear()
        store["owner"] = owner
    return store


class Memo(dict):
    """Bounded memo of a pure function of a string, byte string or number.

    Holds at most two generations of ``limit`` entries: when the young one is
    full it becomes the old one, and entries still in use are carried over.
    With ``twice`` a key is kept from its second miss on, so that the many keys
    that never come back take one byte of a table instead of an entry."""

    SEEN = 1 << 21

    def __init__(self, fn, limit: int, twice: bool = False):
        super().__init__()
        self.fn, self.limit, self.old = fn, limit, {}
        self.seen = bytearray(self.SEEN) if twice else None
        self.fresh = 0

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.fn(key)
            if self.seen is not None:
                slot = hash(key) % self.SEEN
                if not self.seen[slot]:
                    self.seen[slot] = 1
                    self.fresh += 1
                    if self.fresh > self.SEEN // 2:
                        self.seen, self.fresh = bytearray(self.SEEN), 0
                    return v
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = v
        return v


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512, owner: str = "") -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that the Python objects of
    a whole batch of texts are never held at once."""
    worker_store(owner)
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def with_text_columns(df: DataFrame, text: str, new: T.StructType, maker, owner: str = "") -> DataFrame:
    """``df`` with the columns ``new`` computed from the text column in Python.

    ``maker()`` is called once per task and gives a function from an Arrow array
    of texts to the list of the new columns; ``owner`` names what it keeps in the
    worker's store.  Existing columns of the new names
    (in any case) are replaced; all other columns pass through untouched."""
    names = {f.name.lower() for f in new}
    rest = [c for c in df.columns if c.lower() not in names]
    kept = df.select(*[F.col(f"`{c}`") for c in rest])
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("_text_in"))
    n = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = maker()
        for b in parts(batches, owner=owner):
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *of(b.column(n))], names=[*rest, *new.names])

    return source.mapInArrow(run, T.StructType([*kept.schema.fields, *new.fields]))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: written once under ``spark.checkpoint.dir`` and read back."""
    return materialize(df, f"llm-{name}")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the
    body (or a lambda inside it) refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Up to this many ids (some 100 MB as a broadcast relation) a set of ids is
#: broadcast to filter a table of texts; beyond it the texts are joined by shuffle.
BROADCAST_IDS = 2_000_000


def with_ids(df: DataFrame, ids: DataFrame, keep: bool = True, limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``df`` whose ``doc_id`` is (or, without ``keep``, is not) among
    the distinct ``ids`` (one column, a written table).  The count decides only
    between a broadcast and a shuffle; the rows are the same."""
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi" if keep else "left_anti")


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by a sort, several times as fast as ``np.unique`` here)."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def member(a: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Is each value of ``a`` in the sorted array ``of``?"""
    if not len(of):
        return np.zeros(len(a), bool)
    at = np.searchsorted(of, a)
    at[at == len(of)] = 0
    return of[at] == a


#: A key with a larger share of the rows than one in so many is hot; there are fewer hot keys than this.
HOT_SHARE = 1000


def hot_join(rows: DataFrame, keyed: DataFrame, on: str, n_rows: Column) -> DataFrame:
    """Inner equi-join of ``rows`` with ``keyed``, a written table of one row per key.

    ``n_rows``: how many of ``rows`` have the key, an expression over ``keyed``.  The
    hot keys, under ``HOT_SHARE`` of them by construction, are broadcast; the rows of
    the other keys are joined by shuffle, so no task gets one key's large share."""
    total = keyed.agg(F.sum(n_rows).alias("n")).first().n or 0
    is_hot = n_rows * HOT_SHARE > F.lit(total)
    hot = keyed.where(is_hot)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(keyed.where(~is_hot), on))
