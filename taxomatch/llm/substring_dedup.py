"""Substring dedup of word windows by difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document.  Anchors are shorter
windows at the places whose remainder by the period lies in a difference cover:
for any two places there is a shift under the period after which both lie on
the cover.  So two equal windows hold an anchor at the same offset, and only
the windows around anchors that several documents have need to be looked at.

1. Documents with the same word sequence: all but the one of smallest id are
   removed whole, and leave the search.
2. The anchors of the rest are counted by hash (minimum and maximum doc_id).
3. The anchors in two or more documents are extended: every window that holds
   one becomes a 128-bit hash, aggregated to the smallest doc_id.
4. A window with a smaller doc_id than its own is removed.

Hashes, not texts, are shuffled; texts move only for documents with a shared
anchor, in the rewriting steps.  Every aggregate combines on the map side, so
a passage of a third of all documents is one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxomatch.llm.common import distinct, member, parts, with_ids, written

WINDOW = 50
#: A perfect difference set: the differences of its members give every remainder.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: An anchor at an offset under the period lies inside the window.
ANCHOR = WINDOW - PERIOD + 1


def _odd(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(str(i).encode(), seed=seed) | 1 for i in range(n)], np.uint64)


ONE, TWO = _odd(WINDOW, 11), _odd(WINDOW, 12)
ON_COVER = np.isin(np.arange(PERIOD), COVER)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(h: np.ndarray, size: int, factors: np.ndarray) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out += h[i : n + i] * factors[i]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0x9E3779B97F4A7C15)


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places on the cover, hashes of the anchors there)."""
    a = windows(h, ANCHOR, ONE)
    at = np.nonzero(ON_COVER[np.arange(len(a)) % PERIOD])[0]
    return at, a[at]


def candidates(h: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a shared anchor at an offset under the period."""
    n = len(h) - WINDOW + 1
    at, a = anchors(h)
    hit = at[member(a, distinct(shared))]
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, np.maximum(hit - (PERIOD - 1), 0), 1)
    np.add.at(marks, np.minimum(hit, n - 1) + 1, -1)
    return np.nonzero(np.cumsum(marks[:n]) > 0)[0]


def _base(df: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, sequence (digest of the words), kept_sha256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            n, seq, sha = [], [], []
            for t in b.column(1).to_pylist():
                words = (t or "").encode().split()
                joined = b" ".join(words)
                n.append(len(words))
                seq.append(xxhash.xxh3_128_digest(joined))
                sha.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(seq, pa.binary()), pa.array(sha, pa.string())],
                names=["doc_id", "n_words", "sequence", "kept_sha256"])

    return df.mapInArrow(run, "doc_id long, n_words long, sequence binary, kept_sha256 string")


def _anchored(df: DataFrame) -> DataFrame:
    """(doc_id, text) -> the distinct (anchor, doc_id) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            out, ids, held = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = t.encode().split()
                if len(words) >= WINDOW:
                    a = distinct(anchors(word_hashes(words))[1])
                    out.append(a)
                    ids.append(np.full(len(a), i, np.int64))
                    held += len(a)
                if held > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)),
                                                      pa.array(np.concatenate(ids))], names=["anchor", "doc_id"])
                    out, ids, held = [], [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)),
                                                  pa.array(np.concatenate(ids))], names=["anchor", "doc_id"])

    return df.mapInArrow(run, "anchor long, doc_id long")


def _windows(df: DataFrame) -> DataFrame:
    """(doc_id, text, shared) -> (w1, w2, doc_id) of the candidate windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            for i, t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                h = word_hashes(t.encode().split())
                if len(h) < WINDOW:
                    continue
                at = candidates(h, s.values.to_numpy(zero_copy_only=False).view(np.uint64))
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(windows(h, WINDOW, ONE)[at].view(np.int64)),
                         pa.array(windows(h, WINDOW, TWO)[at].view(np.int64)),
                         pa.array(np.full(len(at), i, np.int64))], names=["w1", "w2", "doc_id"])

    return df.mapInArrow(run, "w1 long, w2 long, doc_id long")


def _rewritten(df: DataFrame) -> DataFrame:
    """(doc_id, text, gone: hashes of the windows to remove) -> what is left of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows: list[list] = [[], [], [], [], []]
            for i, t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = t.encode().split()
                h = word_hashes(words)
                w = windows(h, WINDOW, ONE)
                pairs = g.values.flatten()
                one, two = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in pairs)
                hit = member(w, distinct(one))
                if hit.any():  # the second half of the hash of those that have the first
                    at = np.nonzero(hit)[0]
                    known = set(zip(one.tolist(), two.tolist()))
                    w2 = windows(h, WINDOW, TWO)
                    hit[at] = [p in known for p in zip(w[at].tolist(), w2[at].tolist())]
                marks = np.zeros(len(words) + 1, np.int32)
                at = np.nonzero(hit)[0]
                np.add.at(marks, at, 1)
                np.add.at(marks, at + WINDOW, -1)
                keep = np.cumsum(marks[: len(words)]) == 0
                kept = b" ".join([x for x, k in zip(words, keep.tolist()) if k])
                for c, v in zip(rows, (i, xxhash.xxh3_128_digest(b" ".join(words)),
                                       int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest(),
                                       kept.decode())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int64()),
                 pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string())],
                names=["doc_id", "sequence", "n_removed", "left_sha256", "left_text"])

    return df.mapInArrow(run, "doc_id long, sequence binary, n_removed long, left_sha256 string, left_text string")


def dedup_windows(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  texts: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_removed, kept_sha256 (of the kept
    words joined by one space) and, with ``texts``, kept_text.

    A word goes if a window that covers it also starts in a document with a
    smaller doc_id; windows are judged on the input.  Words are runs of bytes
    other than ASCII white space, unchanged.  A null or empty text has no words;
    texts under ``WINDOW`` words lose nothing.  Rows of one doc_id never remove
    each other, so repeated rows give equal results; a row with a null doc_id
    neither removes nor loses words.  Other columns are not looked at.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    base = written(_base(docs), "word-sequences")

    # Documents with the words of a smaller one lose every word.
    first = base.groupBy("sequence").agg(F.min("doc_id").alias("first"))
    base = written(base.join(first, "sequence"), "first-copies")
    copied = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= WINDOW)
    mixed = (base.groupBy("doc_id").agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"))
             .where("lo != hi").select("doc_id"))
    copies = base.where(copied).select("doc_id").distinct().join(mixed, "doc_id", "left_anti")
    long_docs = docs.where("text IS NOT NULL AND doc_id IS NOT NULL")
    rest = with_ids(long_docs, written(copies, "copied-ids"), keep=False)

    # Anchors that two or more documents have.
    found = _anchored(rest)
    shared = (found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
              .where("lo != hi").select("anchor"))
    hits = written(found.join(shared, "anchor").groupBy("doc_id").agg(
        F.collect_list("anchor").alias("shared")), "shared-anchors")  # at most the anchors of one text
    near = with_ids(rest, hits.select("doc_id"))

    # Their windows, by the smallest document that has each.
    wide = written(_windows(near.join(hits, "doc_id").select("doc_id", "text", "shared")), "windows")
    low = wide.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo != hi")
    gone = written(wide.join(low, ["w1", "w2"]).where("doc_id > lo").groupBy("doc_id").agg(
        F.collect_set(F.struct("w1", "w2")).alias("gone")), "removed-windows")
    left = _rewritten(with_ids(rest, gone.select("doc_id")).join(gone, "doc_id").select("doc_id", "text", "gone"))
    if not texts:
        left = left.drop("left_text")
    left = left.dropDuplicates(["doc_id", "sequence"])

    out = base.join(left, ["doc_id", "sequence"], "left")
    whole = copied & F.col("doc_id").isNotNull()
    removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    empty = hashlib.sha256(b"").hexdigest()
    cols = [F.col("doc_id"), F.col("n_words"), removed.cast("long").alias("n_removed"),
            F.when(whole, empty).otherwise(F.coalesce("left_sha256", "kept_sha256")).alias("kept_sha256")]
    if not texts:
        return out.select(*cols)
    # A text without a row in ``left`` keeps all its words.
    return out.join(_joined(docs), "sequence").select(
        *cols, F.when(whole, "").otherwise(F.coalesce("left_text", "words")).alias("kept_text"))


def _joined(df: DataFrame) -> DataFrame:
    """(doc_id, text) -> (sequence, words): each word sequence joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            words = [b" ".join((t or "").encode().split()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(w) for w in words], pa.binary()),
                 pa.array([w.decode() for w in words], pa.string())], names=["sequence", "words"])

    return df.mapInArrow(run, "sequence binary, words string").dropDuplicates(["sequence"])
