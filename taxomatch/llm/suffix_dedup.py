"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a ``WINDOW``-byte string that covers it starts anywhere else.

1. Texts that occur twice or more are removed whole; one of each stays in the
   search as a partner.
2. Each text is cut into chunks of windows with one anchor (``suffix_anchors``).
   Chunks are counted by the bytes of their anchor: a chunk alone is unique; if
   all chunks of a group are equal, all their windows are repeated.
3. Only in mixed groups the suffixes at the anchors are sorted, one for each
   distinct chunk: tasks build sorted runs, exchange them front coded, and merge
   them with a loser tree (``suffix_merge``).  The common prefixes that the merge
   yields, with the bytes before the anchors, tell which windows are repeated.
4. The repeated windows of a text are joined with it and cut out.

A group goes to one bucket of the merge only up to ``GROUP`` distinct chunks;
the windows of a larger one are counted by hash, combined on the map side, so
no task holds more than a few buckets however common a passage is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxomatch.llm.common import parts, with_ids, written
from taxomatch.llm.suffix_anchors import HASHES, WINDOW, chunks
from taxomatch.llm.suffix_merge import expand, front_code, merge, repeated_starts

#: Distinct chunks of a bucket (on average) and of a group (at most) of the merge.
BUCKET, GROUP = 40_000, 100_000
#: Suffixes that a task holds before it sends its runs.
HELD = 60_000

_KEY = "doc_id long, text_key long"
_RANGE = f"{_KEY}, first int, last int"


def _chunked(df: DataFrame) -> DataFrame:
    """(doc_id, text_key, text) -> the chunks of each row: gram (hash of the anchor's
    bytes), chunk (hash of the bytes of all windows), anchor, first and last window."""
    names = ["gram", "chunk", "doc_id", "text_key", "anchor", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            held: list[list] = [[] for _ in names]
            size = 0
            for doc, key, text in zip(*(c.to_pylist() for c in b.columns)):
                data = text.encode()
                at, first, last, gram = chunks(data)
                n = len(at)
                whole = np.fromiter((xxhash.xxh3_64_intdigest(data[x : y + WINDOW]) for x, y in
                                     zip(first.tolist(), last.tolist())), np.uint64, n)
                values = (gram.view(np.int64), whole.view(np.int64), np.full(n, doc), np.full(n, key),
                          at.astype(np.int32), first.astype(np.int32), last.astype(np.int32))
                for h, v in zip(held, values):
                    h.append(v)
                size += n
                if size > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)) for h in held], names=names)
                    held, size = [[] for _ in names], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)) for h in held], names=names)

    return df.select("doc_id", "text_key", "text").mapInArrow(
        run, f"gram long, chunk long, {_KEY}, anchor int, first int, last int")


def _runs(df: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, text_key, text, reps) -> sorted front-coded runs, one row per bucket and flush.

    ``reps``: (gram, anchor, first, last, single) of the distinct chunks of a text."""
    names = ["bucket", "shared", "rest", "left", "places"]

    def flush(held: dict) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in names]
        for bucket, items in held.items():
            items.sort(key=lambda x: x[0])
            shared, rest = front_code([x[0] for x in items])
            for c, v in zip(cols, (bucket, shared, rest, b"".join(x[1] for x in items),
                                   np.array([x[2] for x in items], "<i8").tobytes())):
                c.append(v)
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for b in parts(batches):
            for doc, key, text, reps in zip(*(c.to_pylist() for c in b.columns)):
                data = text.encode()
                for r in reps:
                    at = r["anchor"]
                    suffix = data[at : at + WINDOW].ljust(WINDOW, b"\0")
                    left = data[max(0, at - HASHES + 1) : at].rjust(HASHES - 1, b"\0")
                    held.setdefault(r["gram"] % buckets, []).append(
                        (suffix, left, (doc, key, at, r["first"], r["last"], r["single"])))
                    size += 1
                if size >= HELD:
                    yield flush(held)
                    held, size = {}, 0
        if size:
            yield flush(held)

    return df.select("doc_id", "text_key", "text", "reps").mapInArrow(
        run, "bucket long, shared binary, rest binary, left binary, places binary")


def _merged(runs: DataFrame) -> DataFrame:
    """Runs, all of a bucket together -> ranges of repeated windows of the single chunks."""
    def resolve(rows: list[tuple]) -> pa.RecordBatch:
        order, shared = merge([expand(s, r) for s, r, _, _ in rows])
        starts = np.cumsum([0] + [len(s) // 2 for s, _, _, _ in rows])
        index = np.array([starts[run] + i for run, i in order], np.int64)
        left = np.frombuffer(b"".join(x[2] for x in rows), np.uint8).reshape(-1, HASHES - 1)[index]
        doc, key, at, first, last, single = np.frombuffer(b"".join(x[3] for x in rows), "<i8").reshape(-1, 6)[index].T
        hit = repeated_starts(np.array(shared, np.int64), left, at - last, at - first) & (single[:, None] == 1)
        # Runs of distances: a range of window starts each.
        edge = np.diff(hit.astype(np.int8), axis=1, prepend=0, append=0)
        who, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[who]), pa.array(key[who]), pa.array((at[who] - high + 1).astype(np.int32)),
             pa.array((at[who] - low).astype(np.int32))], names=["doc_id", "text_key", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for b in batches:
            for own, *row in zip(*(c.to_pylist() for c in b.columns)):
                if own != bucket and rows:
                    yield resolve(rows)
                    rows = []
                bucket = own
                rows.append(tuple(row))
        if rows:
            yield resolve(rows)

    return runs.mapInArrow(run, _RANGE)


def _hashed(df: DataFrame) -> DataFrame:
    """The windows of (doc_id, text_key, text, reps) by 128-bit hash, for groups of any size."""
    names = ["w1", "w2", "doc_id", "text_key", "start", "single"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            for doc, key, text, reps in zip(*(c.to_pylist() for c in b.columns)):
                data = text.encode()
                for r in reps:
                    at = np.arange(r["first"], r["last"] + 1)
                    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[s : s + WINDOW]) for s in at.tolist()),
                                      "<i8").reshape(-1, 2)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(np.full(n, doc)),
                         pa.array(np.full(n, key)), pa.array(at.astype(np.int32)),
                         pa.array(np.full(n, bool(r["single"])))], names=names)

    return df.select("doc_id", "text_key", "text", "reps").mapInArrow(
        run, f"w1 long, w2 long, {_KEY}, start int, single boolean")


def _cut(df: DataFrame) -> DataFrame:
    """(doc_id, text_key, text, ranges) -> n_removed, n_spans, left_sha256, left (bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            removed, spans, sha, left = [], [], [], []
            for text, ranges in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                data = text.encode()
                kept, at, n, total = [], 0, 0, 0
                for first, last in sorted((r["first"], r["last"]) for r in ranges):
                    if first > at or not n:  # a new run of removed bytes
                        kept.append(data[at:first])
                        n += 1
                        at = first
                    total += max(0, last + WINDOW - at)
                    at = max(at, last + WINDOW)
                kept.append(data[at:])
                rest = b"".join(kept)
                removed.append(total)
                spans.append(n)
                sha.append(hashlib.sha256(rest).hexdigest())
                left.append(rest)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(sha, pa.string()), pa.array(left, pa.binary())],
                names=["doc_id", "text_key", "n_removed", "n_spans", "left_sha256", "left"])

    return df.select("doc_id", "text_key", "text", "ranges").mapInArrow(
        run, f"{_KEY}, n_removed long, n_spans long, left_sha256 string, left binary")


def _repeated(rest: DataFrame, bucket: int, group: int) -> DataFrame:
    """(doc_id, text_key, first, last): all ranges of repeated windows of ``rest``."""
    found = written(_chunked(rest), "chunks")
    groups = found.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).where("n > 1")
    shared = written(found.join(groups.drop("n"), "gram"), "shared-chunks")
    where = ["doc_id", "text_key", "first", "last"]
    mixed = shared.where("lo != hi")
    one = F.min(F.struct("doc_id", "text_key", "anchor", "first", "last")).alias("rep")
    classes = written(mixed.groupBy("gram", "chunk").agg(F.count(F.lit(1)).alias("n"), one), "distinct-chunks")
    many = mixed.join(classes.where("n > 1").select("gram", "chunk"), ["gram", "chunk"])
    ranges = shared.where("lo = hi").select(*where).unionByName(many.select(*where))

    reps = classes.select("rep.*", "gram", (F.col("n") == 1).cast("int").alias("single"))
    sizes = reps.groupBy("gram").agg(F.count(F.lit(1)).alias("members"))
    reps = written(reps.join(sizes, "gram"), "anchors")

    def texts(own: DataFrame) -> DataFrame:
        """With their text, the distinct chunks of each text (bounded by its length)."""
        per = own.groupBy("doc_id", "text_key").agg(
            F.collect_list(F.struct("gram", "anchor", "first", "last", "single")).alias("reps"))
        return with_ids(rest, own.select("doc_id").distinct()).join(per, ["doc_id", "text_key"])

    usual, large = reps.where(F.col("members") <= group), reps.where(F.col("members") > group)
    count = usual.count()
    if count:
        n = -(-count // bucket)
        runs = _runs(texts(usual), n).repartition(
            max(n, int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bucket")
        ranges = ranges.unionByName(_merged(runs.sortWithinPartitions("bucket")))
    if not large.isEmpty():
        windows = written(_hashed(texts(large)), "windows")
        again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        single = windows.where("single").join(again.select("w1", "w2"), ["w1", "w2"])
        ranges = ranges.unionByName(single.select(
            "doc_id", "text_key", F.col("start").alias("first"), F.col("start").alias("last")))
    return ranges


def dedup_bytes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", kept: bool = False,
                bucket: int = BUCKET, group: int = GROUP) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, n_removed, n_spans (maximal runs of
    removed bytes), kept_sha256 and, with ``kept``, kept_bytes (what is left).

    Strings are judged on the input and never cross rows.  A null text counts as
    empty; texts under ``WINDOW`` bytes lose nothing.  A repeated row is a text of
    its own, so both lose all; rows of one doc_id with different texts are
    separate texts; a null doc_id is treated like any other id.  Other columns are
    not looked at.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("given_id"),
                     F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-1)).alias("doc_id"),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    base = written(docs.select("given_id", "doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"),
                               F.sha2("text", 256).alias("sha")), "digests")
    copies = base.groupBy("sha").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("low"))
    base = written(base.join(copies, "sha"), "copies")
    whole = (F.col("rows") > 1) & (F.col("n_bytes") >= WINDOW)
    # Copies leave the search but for the smallest id (and ids with several texts).
    several = (base.groupBy("doc_id").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi"))
               .where("lo != hi").select("doc_id"))
    out_of = base.where(whole & (F.col("doc_id") > F.col("low"))).select("doc_id").distinct().join(
        several, "doc_id", "left_anti")
    texts = docs.where(F.octet_length("text") >= WINDOW).select("doc_id", "text_key", "text")
    rest = with_ids(texts, written(out_of, "copied-ids"), keep=False)

    ranges = written(_repeated(rest, bucket, group).groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("first", "last")).alias("ranges")), "ranges")
    left = _cut(with_ids(rest, ranges.select("doc_id").distinct()).join(ranges, ["doc_id", "text_key"]))
    if not kept:
        left = left.drop("left")
    left = left.dropDuplicates(["doc_id", "text_key"])

    out = base.join(left, ["doc_id", "text_key"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    cols = [F.col("given_id").alias("doc_id"), "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, empty).otherwise(F.coalesce("left_sha256", "sha")).alias("kept_sha256")]
    if not kept:
        return out.select(*cols)
    untouched = docs.select("doc_id", "text_key", F.encode("text", "utf-8").alias("given")).dropDuplicates(
        ["doc_id", "text_key"])
    return out.join(untouched, ["doc_id", "text_key"]).select(
        *cols, F.when(whole, F.encode(F.lit(""), "utf-8")).otherwise(F.coalesce("left", "given")).alias("kept_bytes"))
