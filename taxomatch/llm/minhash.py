"""Near-duplicate detection with an LSH forest of MinHash signatures.

* A text becomes the set of its hashed word shingles and a signature of
  ``TREES * DEPTH`` minima.  Texts with equal sets are one class from the start.
* Each tree reads the signature from its own place, round the end: one sorted
  order per tree, in which near texts share a long prefix.  A region is the
  texts of a tree with a common prefix.  It starts at ``FIRST`` minima and is
  deepened, region by region, until it holds at most ``REGION`` sets.
* In a region all members are compared by signature.  The best partners are
  confirmed on full sets first; once these links are joined to components, the
  candidates between different components are confirmed where they stand, with
  the full sets of just these members brought to the region.
* Links count only if the full sets reach the similarity.

No step gathers more than about ``REGION`` members: a crowded region is
deepened, and dealt by hash into parts in which its members meet as well.  This
only joins most of a crowd early; the members of different components of a
crowded region are then compared block against block, so that the texts that
meet are the same at every size: those with a common region of ``FIRST`` minima.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxomatch.llm.common import BROADCAST_IDS, distinct, parts, with_ids, written
from taxomatch.llm.components import components

TREES = 16
DEPTH = 6
SIZE = TREES * DEPTH
FIRST = 3
REGION = 1500
#: Depths tried one after the other in crowded regions; the last is the whole signature.
DEPTHS = (4, 5, 6, 8, 11, 16, 24, 48, SIZE)
#: Members of a crowded region that all its parts hold.
HUBS = 8
_CHUNK = 512


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; linked if ``den * intersection >= num * union``."""

    words: int
    num: int
    den: int

    def linked(self, inter: int, union: int) -> bool:
        return self.den * inter >= self.num * union

    @property
    def least_equal(self) -> int:
        """Equal minima under which a pair is not looked at: 4.5 standard
        deviations under the mean of a pair that just reaches the similarity."""
        s = self.num / self.den
        return max(1, math.floor(SIZE * s - 4.5 * math.sqrt(SIZE * s * (1 - s))))


def _constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, from a rule: hashes of the counting numbers."""
    return np.array([xxhash.xxh3_64_intdigest(str(i).encode(), seed=seed) | 1 for i in range(n)], np.uint64)


MULTIPLY, ADD, WORDS = _constants(SIZE, 1), _constants(SIZE, 2), _constants(64, 3)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text; with
    fewer words the whole sequence is one shingle, without words there is none."""
    w = (text or "").encode().lower().split()
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, n)
    k = min(n, words)
    s = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        s += h[i : n - k + 1 + i] * WORDS[i]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x9E3779B97F4A7C15)
    s ^= s >> np.uint64(29)
    return distinct(s + np.uint64(k))


def signature(s: np.ndarray) -> np.ndarray:
    """The minimum of each hash function, upper 32 bits (those of the smallest
    64-bit value are the smallest)."""
    low = np.full(SIZE, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(s), _CHUNK):
        values = MULTIPLY[:, None] * s[None, at : at + _CHUNK]
        values += ADD[:, None]
        np.minimum(low, values.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def region_keys(signatures: np.ndarray, trees: np.ndarray, depth: int) -> np.ndarray:
    """64-bit key of the first ``depth`` minima in the order of each row's tree."""
    at = (trees[:, None] * DEPTH + np.arange(depth)) % SIZE
    values = np.take_along_axis(signatures, at, axis=1).astype("<u4")
    return np.array([xxhash.xxh3_64_intdigest(v.tobytes(), seed=int(t)) for v, t in zip(values, trees)],
                    np.uint64).view(np.int64)


def _signed(df: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, text) -> (doc_id, text_key, node, n_shingles, signature);
    ``node`` is the 128-bit digest of the set and stands for all texts with that set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            nodes, sizes, signs = [], [], []
            for t in b.column(2).to_pylist():
                s = shingles(t, words)
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(signs, pa.binary())], names=["doc_id", "text_key", "node", "n_shingles", "signature"])

    return df.select("doc_id", "text_key", "text").mapInArrow(
        run, "doc_id long, text_key long, node binary, n_shingles long, signature binary")


def _sets(df: DataFrame, words: int) -> DataFrame:
    """(doc_id, text, wanted) -> (node, shingles) of the texts whose node is the wanted one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            nodes, sets = [], []
            for t, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(t, words).tobytes()
                if xxhash.xxh3_128_digest(s) == wanted:
                    nodes.append(wanted)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())],
                                             names=["node", "shingles"])

    return df.select("text", "wanted").mapInArrow(run, "node binary, shingles binary")


def _keyed(df: DataFrame, depth: int | None) -> DataFrame:
    """(node, n_shingles, signature[, tree]) -> rows (key, node, tree), of all trees at
    the first depth, or of the given tree at ``depth``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            nodes = b.column(0)
            signs = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, SIZE)
            if depth is None:
                trees = np.tile(np.arange(TREES), len(signs))
                rows = np.repeat(np.arange(len(signs)), TREES)
            else:
                trees = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                rows = np.arange(len(signs))
            for at in range(0, len(rows), 1 << 16):
                r, t = rows[at : at + (1 << 16)], trees[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(region_keys(signs[r], t, depth or FIRST)), nodes.take(pa.array(r)),
                     pa.array(t.astype(np.int32))], names=["key", "node", "tree"])

    cols = ["node", "signature"] + ["tree"] * (depth is not None)
    return df.select(*cols).mapInArrow(run, "key long, node binary, tree int")


def _hubs(crowds: DataFrame) -> DataFrame:
    """(key, node) of up to ``HUBS`` members of each crowded region that are in the
    most crowded regions: the template of a crowd of copies is in nearly all of them."""
    score = written(crowds.groupBy("node").agg(F.count(F.lit(1)).alias("score")), "scores")
    slot = F.pmod(F.xxhash64("node"), F.lit(HUBS)).alias("slot")
    best = crowds.join(score, "node").groupBy("key", slot).agg(F.max(F.struct("score", "node")).alias("best"))
    return best.select("key", F.col("best.node").alias("node"))


def regions(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, node) of regions with at least two members that one task compares, and
    (key, node) of the regions of ``FIRST`` minima that are too large for one.

    A region over ``REGION`` members is deepened, and is also dealt by a hash of
    its members into parts of about half that size, each with the region's hubs.
    This finds most links of a crowd; ``_blocks`` compares what it leaves."""
    def counted(rows: DataFrame) -> DataFrame:
        own = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return written(rows.join(own, "key"), "regions")

    out, crowds = None, []
    for depth in (FIRST, *DEPTHS):
        rows = crowds[-1].select("node", "tree").join(classes, "node") if crowds else classes
        found = counted(_keyed(rows, depth if crowds else None))
        crowded = found.where(F.col("n") > REGION)
        small = found.where(F.col("n") <= REGION).select("key", "node")
        out = small if out is None else out.unionByName(small)
        if crowded.isEmpty():
            break
        crowds.append(crowded)
    if not crowds:
        return out.distinct(), None
    every = reduce(DataFrame.unionByName, crowds)
    part = F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("n") / (REGION // 2)))
    cut = every.select("key", F.xxhash64("key", part).alias("part"), "node")
    hubs = cut.select("key", "part").distinct().join(_hubs(every), "key")
    for rows in (cut, hubs):
        out = out.unionByName(rows.select(F.col("part").alias("key"), "node"))
    return out.distinct(), crowds[0].select("key", "node")


def _blocks(members: DataFrame) -> DataFrame:
    """(key, node, label, ..) of crowded regions -> the same columns, a key for each
    two blocks of about ``REGION / 2`` members of a region, so that any two members
    of different labels meet under a key.  Labels that fill blocks of their own are
    not compared with themselves."""
    half = REGION // 2
    sizes = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("of_label"))
    large = sizes.where(F.col("of_label") >= half)
    rest = sizes.where(F.col("of_label") < half).groupBy("key").agg(F.sum("of_label").alias("others"))
    own = F.col("of_label").isNotNull()
    block = F.struct(
        F.when(own, F.col("label")).alias("label"),
        F.pmod(F.xxhash64("node"), F.ceil(F.coalesce("of_label", "others") / half)).alias("part"))
    dealt = written(members.join(large, ["key", "label"], "left").join(rest, "key", "left")
                    .select(*members.columns, block.alias("block")), "blocks")
    one = dealt.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n")).drop("n")
    two = one.select("key", F.col("block").alias("other"))
    same = F.col("block.label").isNotNull() & F.col("other.label").eqNullSafe(F.col("block.label"))
    pairs = written(one.join(two, "key").where((F.col("block") <= F.col("other")) & ~same).withColumn(
        "task", F.xxhash64("key", "block", "other")), "block-pairs")
    sides = pairs.select("key", "block", "task").unionByName(
        pairs.where("block != other").select("key", F.col("other").alias("block"), "task"))
    met = dealt.alias("d").join(sides.alias("s"), (F.col("d.key") == F.col("s.key")) & F.col("d.block").eqNullSafe(
        F.col("s.block")))
    return met.select(F.col("s.task").alias("key"), *[F.col(f"d.{c}") for c in members.columns if c != "key"])


def _by_region(df: DataFrame, columns: list[str], of, schema: str) -> DataFrame:
    """Rows of ``of(list per column)`` for each group of equal ``key``; groups are
    brought together by a shuffle and streamed, one in memory at a time."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    kinds = {"binary": pa.binary(), "long": pa.int64()}
    types = [kinds[f.strip().split(" ")[1]] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [[] for _ in columns]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            cols = [c.to_pylist() for c in b.columns[1:]]
            rows: list[tuple] = []
            starts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist(), len(keys)] if len(keys) else []
            for s, e in zip(starts, starts[1:]):
                if keys[s] != key:
                    if len(held[0]) > 1:
                        rows += of(key, *held)
                    key, held = keys[s], [[] for _ in columns]
                for h, c in zip(held, cols):
                    h.extend(c[s:e])
            if rows:
                yield batch(rows)
        if len(held[0]) > 1 and (rows := of(key, *held)):
            yield batch(rows)

    return df.select("key", *columns).repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _alike(rule: Rule, sizes: list, signs: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, equal minima, is a candidate) for blocks of rows against all members."""
    matrix = np.frombuffer(b"".join(signs), np.uint8).reshape(-1, SIZE)
    size = np.array(sizes, np.int64)
    step = max(1, (1 << 22) // (len(size) * SIZE))
    for at in range(0, len(size), step):
        equal = (matrix[at : at + step, None, :] == matrix[None, :, :]).sum(axis=2, dtype=np.int16)
        x, y = size[at : at + step, None], size[None, :]
        fits = (equal >= rule.least_equal) & (rule.den * np.minimum(x, y) >= rule.num * np.maximum(x, y))
        fits[np.arange(len(fits)), at + np.arange(len(fits))] = False
        yield at, equal, fits


def _candidates(members: DataFrame, rule: Rule) -> DataFrame:
    """(key, node, n_shingles, bytes) -> pairs (a, b), a < b: for every member its best
    partner of the region and its best partner of smaller node.  Of equally good
    ones the smallest node is taken, so that the trees agree."""
    def pairs(key, nodes: list, sizes: list, signs: list) -> list[tuple]:
        order = sorted(range(len(nodes)), key=nodes.__getitem__)
        nodes, sizes, signs = ([c[i] for i in order] for c in (nodes, sizes, signs))
        out = []
        for at, equal, fits in _alike(rule, sizes, signs):
            equal = np.where(fits, equal, -1)
            smaller = np.where(np.arange(len(nodes))[None, :] < at + np.arange(len(equal))[:, None], equal, -1)
            for e in (equal, smaller):
                best = e.argmax(axis=1)
                for i in np.nonzero(e[np.arange(len(e)), best] >= 0)[0].tolist():
                    j = int(best[i])
                    out.append((nodes[min(at + i, j)], nodes[max(at + i, j)]))
        return out

    return _by_region(members, ["node", "n_shingles", "bytes"], pairs, "a binary, b binary").distinct()


def _crossing(members: DataFrame, rule: Rule) -> DataFrame:
    """(key, node, n_shingles, bytes, label) -> (key, node, label) of the members that
    have a candidate with another label in their region."""
    def crossing(key, nodes: list, sizes: list, signs: list, labels: list) -> list[tuple]:
        code: dict = {}
        own = np.array([code.setdefault(x, len(code)) for x in labels])
        out = []
        for at, _, fits in _alike(rule, sizes, signs):
            fits &= own[at : at + len(fits), None] != own[None, :]
            out += [(int(key), nodes[at + i], labels[at + i]) for i in np.nonzero(fits.any(axis=1))[0].tolist()]
        return out

    return _by_region(members, ["node", "n_shingles", "bytes", "label"], crossing,
                      "key long, node binary, label binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets."""
    n = len(sets)
    if n <= 24:
        out = np.zeros((n, n), np.int64)
        for i in range(n):
            for j in range(i):
                both = np.concatenate([sets[i], sets[j]])
                both.sort(kind="stable")  # two sorted runs are merged
                out[i, j] = out[j, i] = (both[1:] == both[:-1]).sum()
        return out
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    out = np.zeros((n, n), np.float64)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        block = np.zeros((n, width), np.float32)
        block[owner[lo:hi], column[lo:hi] - at] = 1
        out += block @ block.T  # sums under 4097: exact
    return out.astype(np.int64)


def _linked_across(crossing: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links between members of different labels, confirmed on full sets inside the
    region; of the links between the same components one is enough."""
    def links(key, nodes: list, labels: list, shingles: list) -> list[tuple]:
        own = [np.frombuffer(x, np.uint64) for x in shingles]
        size = np.array([len(x) for x in own])
        inter = intersections(own)
        hit = rule.den * inter >= rule.num * (size[:, None] + size[None, :] - inter)
        parent = {x: x for x in labels}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        out = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.tril(hit, -1)))):
            p, q = find(labels[i]), find(labels[j])
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((nodes[i], nodes[j]))
        return out

    return _by_region(crossing.join(sets, "node"), ["node", "label", "shingles"], links, "a binary, b binary").distinct()


def _low_bytes(signature):
    """The low byte of each minimum: enough to compare signatures, a quarter of the size."""
    @F.pandas_udf("binary")
    def low(s):
        return s.map(lambda x: np.frombuffer(x, "<u4").astype(np.uint8).tobytes())

    return low(signature)


def _confirmed(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two sorted runs are merged
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(rule.linked(inter, len(both) - inter))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _placed(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, text) -> (doc_id, text_key, node, n_shingles) of every row,
    and (node, root) of every set: root is the component's smallest set."""
    signed = written(_signed(docs, rule.words), "signatures")
    classes = written(
        signed.where("node IS NOT NULL").groupBy("node").agg(
            F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature")),
        "classes")
    small = classes.select("node", "n_shingles", _low_bytes("signature").alias("bytes"))
    compared, crowds = regions(classes)
    members = written(compared.join(small, "node"), "members")

    def fetched(nodes: DataFrame) -> DataFrame:
        wanted = classes.join(nodes, "node").select(F.col("text_key").alias("doc_id"), F.col("node").alias("wanted"))
        wanted = written(wanted, "wanted")
        texts = docs.select(F.col("text_key").alias("doc_id"), "text")  # a key that is never null
        near = with_ids(texts, wanted.select("doc_id").distinct()).join(wanted, "doc_id")
        return written(_sets(near, rule.words).dropDuplicates(["node"]), "sets")

    first = written(_candidates(members, rule), "pairs")
    sets = fetched(first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct())
    links = written(_confirmed(first, sets, rule), "links")
    joined = components(links)

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows, with labels, of the regions that hold several components."""
        label = rows.join(joined, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        keys = label.groupBy("key").agg(
            F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("content")).where("lo != hi")
        keys = keys.groupBy("n", "content").agg(F.min("key").alias("key")).select("key")  # equal regions once
        return label.join(keys, "key", "left_semi")

    def with_more(more: DataFrame) -> DataFrame:
        if more.isEmpty():
            return joined
        stars = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
        return components(stars.unionByName(more))

    # What is left: candidates between different components of one region.
    crossing = written(_crossing(mixed(members), rule), "crossing")
    joined = with_more(written(_linked_across(crossing, sets, rule), "more-links"))
    if crowds is not None:
        apart = written(mixed(crowds), "crowds")
        if not apart.isEmpty():
            crossing = written(_crossing(_blocks(apart.join(small, "node")), rule), "crowd-crossing")
            new = crossing.select("node").distinct().join(sets, "node", "left_anti")
            sets = sets.unionByName(fetched(new))
            joined = with_more(written(_linked_across(crossing, sets, rule), "crowd-links"))
    roots = classes.select("node").join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return signed.drop("signature"), roots


def near_duplicates(df: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id (the smallest
    doc_id that links reach, itself included) and kept (doc_id is component_id).

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased.
    A null or empty text has no shingles and is its own component.  Texts with
    equal sets (copies, repeated rows) always share a component.  Rows of one
    doc_id with different texts are separate texts; a null doc_id joins its
    text's component, is never a component_id and never kept where the
    component has an id.  Other columns are not looked at.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                     F.xxhash64(f"`{doc_id}`", f"`{text}`").alias("text_key"))
    rows, roots = _placed(docs, rule)
    own = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(roots, "node")
    low = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = own.join(low, "root").select("node", "component_id")
    out = rows.drop("text_key").join(labels, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def one_of_each(df: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, with one row of each component: the one
    of smallest doc_id (null last), then smallest hash of the text.

    Texts without words are linked with nothing and all stay; of rows with one
    doc_id and one text, one stays.
    """
    id_key, text_key = "_id_key", "_text_key"
    keyed = df.withColumns({id_key: F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-1)),
                            text_key: F.xxhash64(f"`{doc_id}`", f"`{text}`")})
    docs = keyed.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                        F.col(text_key).alias("text_key"))
    rows, roots = _placed(docs, rule)
    # Nulls last, then by id: the first of each component.
    mine = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    per_set = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(mine).alias("low")).join(roots, "node")
    chosen = per_set.groupBy("root").agg(F.min("low").alias("chosen"))
    chosen = per_set.join(chosen, "root").select("node", "chosen")
    counted = (rows.where("node IS NOT NULL").groupBy("node", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
               .join(chosen, "node"))
    first = F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("text_key") == F.col("chosen.text_key"))
    marked = written(counted.withColumn("first", first).where("NOT first OR n > 1").select(
        F.coalesce("doc_id", F.lit(-1)).alias(id_key), F.col("text_key").alias(text_key), "first"), "marked")
    gone, again = marked.where("NOT first").drop("first"), marked.where("first").drop("first")
    keys = [id_key, text_key]
    small = lambda d: F.broadcast(d) if d.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else d
    kept = keyed.join(small(gone), keys, "left_anti")
    if not again.isEmpty():  # rows that repeat: only these are brought together
        again = small(again)
        kept = kept.join(again, keys, "left_anti").unionByName(
            kept.join(again, keys, "left_semi").dropDuplicates(keys))
    return kept.drop(*keys)
