"""Shards of near equal size by longest-processing-time scheduling.

Groups that must stay together (equal texts) are taken from the largest to the
smallest, and each goes to the shard with the least load.  Groups of one size
are interchangeable, so the heap deals whole size classes: while the same
shards take turns, their turns are one entry (a cycle and how often it is
gone through), not one entry per group.  Only the size classes, of which a
corpus of B bytes has at most sqrt(2 B), pass through the one task that holds
the heap; the groups find their shard by their place in the order, and the
documents by their group, in joins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxomatch.llm.common import hot_join, written
from taxomatch.operators.rows import range_partitions, with_row_index

#: Up to this many size classes (some 100 MB) are broadcast to the groups; more are joined by shuffle.
BROADCAST_CLASSES = 500_000


def deal(heap: list[tuple[int, int]], size: int, n: int) -> list[tuple[int, list[int]]]:
    """Deal ``n`` groups of ``size`` bytes to the heap of (load, shard): the turns
    [(groups, cycle of shards)], in order.  The heap is changed in place.

    The shards that get a group before the least loaded one gets its second take
    turns; that set stays the same until their loads reach the next shard."""
    turns = []
    while n:
        least = heap[0]
        turn = []
        while heap and heap[0] < (least[0] + size, least[1]):
            turn.append(heapq.heappop(heap))
        rounds = n // len(turn)
        if heap:  # rounds until the next shard is under the second group of the least
            load, shard = heap[0]
            gap = load - least[0]
            rounds = min(rounds, max(1, gap // size + (gap % size > 0 or shard > least[1]) - 1))
        given = rounds * len(turn)
        if not rounds:
            rounds, given = 1, n
        turns.append((given, [j for _, j in turn]))
        for i, (load, j) in enumerate(turn):
            heapq.heappush(heap, (load + rounds * size * (i < given), j))
        n -= given
    return turns


def _schedule(shards: int):
    """(group_size, n) in descending order of size -> the turns of each size class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = [(0, j) for j in range(shards)]
        place = 0
        for b in batches:
            out = []
            for size, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                entry = []
                for given, cycle in deal(heap, size, n):
                    entry.append({"first": place, "end": place + given, "cycle": cycle})
                    place += given
                out.append(entry)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out, pa.list_(pa.struct([
                    ("first", pa.int64()), ("end", pa.int64()), ("cycle", pa.list_(pa.int32()))])))],
                names=["group_size", "turns"])

    return run


def sharded(rows: DataFrame, key: str, size: str, shards: int) -> DataFrame:
    """``rows`` with ``shard`` and ``place`` (that of the row's group in the order of
    the schedule).  Rows of one ``key`` (not null) stay together; ``size`` is at least 1."""
    groups = written(rows.groupBy(key).agg(F.sum(size).cast("long").alias("group_size"),
                                           F.count(F.lit(1)).alias("n_rows")), "shard-groups")
    # Largest first; equal sizes by key.
    placed = with_row_index(groups, [F.desc("group_size"), F.col(key)], "place")
    classes = written(groups.groupBy("group_size").agg(F.count(F.lit(1)).alias("n"))
                      .repartition(1).sortWithinPartitions(F.desc("group_size"))
                      .mapInArrow(_schedule(shards), "group_size long, turns array<struct<first:long,end:long,cycle:array<int>>>"),
                      "shard-turns")
    small = classes.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    turn = F.filter("turns", lambda t: (F.col("place") >= t["first"]) & (F.col("place") < t["end"]))[0]
    dealt = placed.join(F.broadcast(classes) if small else classes, "group_size").withColumn("_turn", turn).select(
        key, "place", "n_rows",
        F.element_at("_turn.cycle", ((F.col("place") - F.col("_turn.first")) % F.size("_turn.cycle")).cast("int") + 1)
        .alias("shard"))
    return hot_join(rows, written(dealt, "shard-of-groups"), key, F.col("n_rows")).drop("n_rows")


def shard_documents(df: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, size (UTF-8 bytes and one), text_crc32
    (unsigned), shard (0 to ``shards`` - 1) and slot (0, 1, .. in each shard).

    Equal texts share a shard; a null text is the empty one.  The slots follow the
    schedule: largest group first, then by doc_id (null first).  Repeated rows are
    rows of their own.  A group larger than the mean shard makes its shard the
    largest: no split is allowed.  An empty table gives no row; other columns are
    not looked at.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = written(df.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"),
                             F.crc32(t).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("text_key")), "shard-rows")
    dealt = sharded(rows, "text_key", "size", shards).drop("text_key")
    order: list[str | Column] = ["shard", "place", F.asc_nulls_first("doc_id")]
    numbered = with_row_index(dealt, order, "position", num_partitions=range_partitions(rows))
    first = numbered.groupBy("shard").agg(F.min("position").alias("first"))  # one row per shard
    return numbered.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        (F.col("position") - F.col("first")).alias("slot"))


def oracle(shards: int = 16) -> str:
    """The same in DuckDB SQL over ``documents``: one recursion step per group."""
    least = "list_position(loads, list_min(loads))"
    # CRC-32 byte by byte, with the table of the reflected polynomial 0xEDB88320.
    byte = "list_reduce([b, 0, 1, 2, 3, 4, 5, 6, 7], lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
    return f"""
    WITH RECURSIVE crc AS MATERIALIZED (SELECT list({byte} ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
    texts AS MATERIALIZED (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
    keyed AS MATERIALIZED (
        SELECT text, sha256(text) AS key, xor(list_reduce([4294967295] || [('0x' || p)::BIGINT for p in
                   regexp_extract_all(hex(encode(text)), '..')], lambda s, b: xor(s // 256, t[xor(s, b) % 256 + 1])), 4294967295) AS crc
        FROM texts, crc),
    rows_ AS MATERIALIZED (SELECT doc_id, strlen(text) + 1 AS size, crc, key
                           FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) JOIN keyed USING (text)),
    placed AS MATERIALIZED (SELECT key, sum(size)::BIGINT AS bytes, row_number() OVER (ORDER BY sum(size) DESC, key) AS place
                            FROM rows_ GROUP BY key),
    dealt AS (SELECT 0::BIGINT AS place, list_transform(range({shards}), lambda i: 0::BIGINT) AS loads, -1::BIGINT AS shard
              UNION ALL
              SELECT p.place, list_transform(loads, lambda x, i: x + CASE WHEN i = {least} THEN p.bytes ELSE 0 END), {least} - 1
              FROM dealt JOIN placed p ON p.place = dealt.place + 1)
    SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
    FROM rows_ JOIN placed USING (key) JOIN dealt USING (place)"""
