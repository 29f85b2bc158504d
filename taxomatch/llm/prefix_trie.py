"""Prefix trie of conversations by time-forward processing.

A node is a distinct sequence of first turns; its members are the
conversations that start with it.

1. Turns become digests; each conversation is one sorted stream that chains
   them, so a node is known by the digest of its turns, and no text is shuffled.
2. Equal nodes are one row: smallest member, number of members (combined on the
   map side: a first turn of a third of all conversations is one row per task).
3. Totals of subtrees go up by time-forward processing: the nodes are sorted by
   descending depth, and each sends its totals to its parent through a priority
   queue that spills (``spill_queue``).  A node with many members is crowded; a
   node that is not crowded but whose parent is one is the root of a shard.
   Shards are processed side by side, then the crowded nodes above them, each
   starting with the sums of its shard roots.  Fewer than ``SHARES`` nodes of a level
   are crowded, whatever the input, so that last pass is short.
4. The members that end at a node are hashed in order of their id: sorted ranges
   become pieces, and the pieces of a node are hashed one after the other.

One conversation is one stream of digests (some 60 bytes a turn), sorted by
Spark; the state of a stream is its last digest and the head of its family.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxomatch.llm.common import BROADCAST_IDS, parts, written
from taxomatch.llm.spill_queue import SpillQueue

#: A node is crowded with more than this share (one in so many) of the conversations.
SHARES = 1000
LEAST_CROWD = 64

#: Conversations of one family (conv_id - conv_id % FAMILY) start with up to HEAD - 1 turns of its first.
FAMILY, HEAD = 5, 9

ROOT = b""
_CHAIN = "conv_id long, depth long, node binary, parent binary, n_bytes long, last boolean"
_IDS_IN_PIECE = 1 << 15


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields)],
                                      names=[n for n, _ in fields])


def turn_digests(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """conv_id, turn, role, digest of role and text, n_bytes of the text; null role or text
    is empty, rows without a conv_id are left out."""
    r, t = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    return df.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), r.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256)).alias("digest"),
        F.octet_length(t).cast("long").alias("n_bytes"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, family, heads, digest, n_bytes) -> one row per conversation and depth,
    the root included.  ``heads``: how many turns a conversation takes from the
    conversation whose id is the family."""
    family = conv = pending = None
    head: list = []
    depth = at = 0
    node, out = ROOT, []

    def step(row):
        nonlocal pending
        if pending is not None:
            out.append((*pending, False))
        pending = row

    for b in parts(batches, 8192, owner="prefix_trie"):
        for c, f, h, digest, n_bytes in zip(*[x.to_pylist() for x in b.columns]):
            if f != family:
                family, head = f, []
            if c != conv:
                if pending is not None:
                    out.append((*pending, True))
                pending = None
                conv, at, depth, node = c, 0, 0, ROOT
                step((c, 0, ROOT, None, 0))
                if c != f:
                    for taken in head[:h]:
                        depth, node = depth + 1, taken[0]
                        step((c, depth, *taken))
            at += 1
            if c == f or at > h:
                depth, parent = depth + 1, node
                node = hashlib.sha256(parent + digest).digest()[:16]
                step((c, depth, node, parent, n_bytes))
                if c == f and at < HEAD:
                    head.append((node, parent, n_bytes))
        yield _batch(out, _CHAIN)
        out.clear()
    if pending is not None:
        yield _batch([(*pending, True)], _CHAIN)


def chained(turns: DataFrame, heads: bool = False) -> DataFrame:
    """One row per conversation and depth: conv_id, depth (root: 0), node, parent, n_bytes
    of its last turn, last (the conversation ends here).

    With ``heads`` conversation c is rebuilt first: the first h turns of conversation
    c - c % FAMILY (all if it has fewer, none if there is none) and then c's own turns
    after its first h; h is the unsigned CRC-32 of c's decimal digits modulo HEAD.
    Turns are taken by number (null first), equal numbers by role and digest.
    """
    c = F.col("conv_id")
    rows = turns.withColumns({
        "family": (c - c % FAMILY) if heads else c,
        "heads": (F.crc32(c.cast("string").cast("binary")) % HEAD if heads else F.lit(0)).cast("int")})
    rows = rows.repartition("family").sortWithinPartitions(
        "family", (c != F.col("family")), "conv_id", F.asc_nulls_first("turn"), "role", "digest")
    return rows.select("conv_id", "family", "heads", "digest", "n_bytes").mapInArrow(_chain, _CHAIN)


_IN = ["node", "parent", "depth", "top", "conv_id", "n_convs", "n_bytes", "n_children", "n_leaves", "saved"]
_TOTALS = "node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long"


def _key(depth: int, node: bytes) -> bytes:
    """Sorts like (descending depth, node)."""
    return ((1 << 63) - 1 - depth).to_bytes(8, "big") + node.rjust(16, b"\0")


def time_forward(limit: int):
    """Nodes sorted by (descending depth, node) -> their totals.  ``n_children``, ``n_leaves`` and
    ``saved`` of the input come from other shards; a ``top`` node sends nothing here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillQueue(limit)
        for b in parts(batches, 8192, owner="prefix_trie"):
            out = []
            for node, parent, depth, top, conv, n_convs, n_bytes, children, leaves, saved in zip(
                    *[x.to_pylist() for x in b.columns]):
                n, more_leaves, more_saved = queue.take(_key(depth, node))
                children += n
                leaves = leaves + more_leaves if children else 1
                saved += more_saved + (n_convs - 1) * n_bytes
                if not top:
                    queue.push(_key(depth - 1, parent), leaves, saved)
                out.append((node, parent, depth, conv, n_convs, children, leaves, saved))
            yield _batch(out, _TOTALS)
        if queue.first() is not None:
            raise RuntimeError("a message found no node")

    return run


def _ends(rows: DataFrame) -> DataFrame:
    """(node, conv_id) of the conversations that end at a node -> node, ends_sha256."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = "node binary, first long, ids string"
        node, ids = None, []
        for b in parts(batches, 1 << 16, owner="prefix_trie"):
            out = []
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n != node or len(ids) >= _IDS_IN_PIECE:
                    if ids:
                        out.append((node, ids[0], ",".join(map(str, ids))))
                    node, ids = n, []
                ids.append(c)
            yield _batch(out, schema)
        if ids:
            yield _batch([(node, ids[0], ",".join(map(str, ids)))], schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = "node binary, ends_sha256 string"
        node = sha = None
        for b in parts(batches, 1024, owner="prefix_trie"):
            out = []
            for n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n != node:
                    if sha is not None:
                        out.append((node, sha.hexdigest()))
                    node, sha = n, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _batch(out, schema)
        if sha is not None:
            yield _batch([(node, sha.hexdigest())], schema)

    cut = (rows.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
           .mapInArrow(pieces, "node binary, first long, ids string"))
    return (cut.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
            .mapInArrow(hashed, "node binary, ends_sha256 string"))


def prefix_trie(chain: DataFrame, queue_limit: int = 1 << 18, least_crowd: int = LEAST_CROWD) -> DataFrame:
    """One row per node of the ``chained`` conversations: conv_id (its smallest member),
    depth, parent_conv_id (null at the root), n_convs (members), n_children,
    n_leaves (childless nodes of its subtree, itself included), saved_tokens (over
    its subtree, (n_convs - 1) times the bytes of the last text), ends_sha256 (of the
    ids of the members that end here, ascending, comma-joined).

    No conversation, no row.  A conversation without turns is a member of the root.
    """
    chain = written(chain, "trie-chains")
    nodes = written(chain.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
        F.count(F.lit(1)).alias("n_convs"), F.min("n_bytes").alias("n_bytes")), "trie-nodes")

    # Crowded nodes: the root and all with many members; under SHARES of them on a level.
    n_convs = chain.where("depth = 0").count()
    crowd = max(least_crowd, n_convs // SHARES)
    is_crowded = (F.col("n_convs") > crowd) | (F.col("depth") == 0)
    crowded = written(nodes.where(is_crowded), "trie-crowded")
    keys = crowded.select("node", F.lit(True).alias("crowded"))
    small = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    # The shard of a node is the first node on its smallest member's way that is not crowded.
    free = chain.join(F.broadcast(keys) if small else keys, "node", "left_anti")
    shard = free.groupBy("conv_id").agg(F.min_by("node", "depth").alias("shard"))
    light = nodes.where(~is_crowded).join(shard, "conv_id")

    def forward(df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions(F.desc("depth"), "node").select(*_IN).mapInArrow(
            time_forward(queue_limit), _TOTALS)

    zero = F.lit(0).cast("long")
    below = written(forward(light.withColumns({
        "top": F.col("node") == F.col("shard"), "n_children": zero, "n_leaves": zero, "saved": zero})
        .repartition("shard")), "trie-shards")

    # Across shards: the roots of shards are the nodes below whose parent is crowded.
    crowd_keys = crowded.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    near = F.broadcast(crowd_keys) if small else crowd_keys
    sums = (below.join(near, "parent").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")))
    above = written(forward(crowded.join(sums, "node", "left").withColumns({
        "top": F.col("depth") == 0, **{c: F.coalesce(c, zero) for c in ("n_children", "n_leaves", "saved")}})
        .repartition(1)), "trie-crowns")

    # The parent's smallest member: crowded parents are broadcast, the others have few children.
    under = below.unionByName(above)
    inner = below.join(near, "parent", "left_anti").join(
        below.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    named = under.join(near, "parent").unionByName(inner).unionByName(
        above.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    ends = _ends(chain.where("last").select("node", "conv_id"))
    return named.join(ends, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def oracle() -> str:
    """The same in DuckDB SQL over ``conversations``, rebuilt."""
    # CRC-32 of the decimal digits: eight steps a byte, the reflected polynomial 0xEDB88320.
    byte = ("list_reduce([xor(s, b), 0, 1, 2, 3, 4, 5, 6, 7], lambda a, i: "
            "CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)")
    crc = (f"xor(list_reduce([4294967295] || [ord(x)::BIGINT for x in string_split(c::VARCHAR, '')], "
           f"lambda s, b: {byte}), 4294967295)")
    return f"""
    WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                      sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos, coalesce(role, '') AS r, coalesce(text, '') AS x
               FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT c, c - c % 5 AS f, {crc} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
    heads AS (SELECT i.c, b.pos AS d, b.r, b.x FROM ids i JOIN t b ON b.c = i.f AND b.pos <= i.h),
    taken AS (SELECT c, count(*) AS k FROM heads GROUP BY c),
    turns AS (SELECT * FROM heads UNION ALL
              SELECT t.c, coalesce(k, 0) + t.pos - i.h, t.r, t.x FROM t JOIN ids i USING (c) LEFT JOIN taken USING (c) WHERE t.pos > i.h),
    keyed AS (SELECT c, 0 AS d, '' AS key, 0 AS bytes FROM ids UNION ALL
              SELECT c, d, string_agg(md5(strlen(r) || ':' || r || x), '') OVER (PARTITION BY c ORDER BY d), strlen(x) FROM turns),
    rows_ AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS parent,
                     d = max(d) OVER (PARTITION BY c) AS ends FROM keyed),
    nodes AS (SELECT key, min(c) AS conv_id, min(d) AS depth, min(parent) AS parent, count(*) AS n_convs, min(bytes) AS bytes,
                     sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
              FROM rows_ GROUP BY key),
    kids AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
    up AS (SELECT w.key, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved
           FROM nodes u LEFT JOIN kids ON kids.parent = u.key JOIN rows_ w ON w.c = u.conv_id AND w.d <= u.depth GROUP BY w.key)
    SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(kids.n, 0) AS n_children,
           up.n_leaves, up.saved::BIGINT AS saved_tokens, v.ends_sha256
    FROM nodes v JOIN up USING (key) LEFT JOIN kids ON kids.parent = v.key LEFT JOIN nodes p ON p.key = v.parent"""
