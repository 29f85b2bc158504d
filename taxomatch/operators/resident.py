"""Exact search (J1, L1-L3) with the item side resident in the Python workers.

For dense items of a counted, bounded size (``knn.RESIDENT_BYTES``).  The items are
broadcast once as flat Arrow buffers; a worker decodes them at its first batch and
keeps them, so the rows sent to Python are the queries alone, a narrow pass over
their scan without a join, a shuffle or a merge of partial lists.

Items of one model and list lie in blocks.  From ``pivot_rows`` items of a model on,
rows picked by a hash of ``doc_ord`` are its pivots (about the square root of the
items) and every item joins its nearest pivot in a Spark pass; below that a list is one
block.  A worker knows centre and radius of each block.  By the triangle inequality no
item of a block is nearer than the distance to the centre less the radius, so blocks
beyond the query's k-th hit are skipped; where that promises to save work a query scores
its nearest block first.  The bound allows for rounding, so ties and lists are those of
the full search.  It holds for ``l2`` and, on unit vectors, for ``cosine``; ``dot`` has no
such bound and scores all blocks.  In many dimensions, without clusters, few blocks can be
skipped: then many blocks share one product, see ``ItemList.nearest``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from taxomatch.operators import knn

#: Items of a block and queries of a step.
BLOCK = 2048
#: Items of the blocks that one product scores (or one block), for so many queries at a time
#: (256 x 4096 numbers of single precision are 4 MB and stay in the cache).
CHUNK, TILE = 4096, 256
#: Blocks are scored one by one where less than one in so many (query, block) pairs is needed.
SPARSE = 4
#: (query, item) pairs that wait for their exact distance.
MOST_WAITING = 1 << 20

COUNT_SCHEMA = "model string, cat_type string, blocks long, scored long"


def _matrix(column) -> np.ndarray:
    """A list<double> column (no nulls) as one matrix over its flat buffer."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _units(m: np.ndarray) -> np.ndarray:
    """Rows of norm one; a row of zeros stays."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * (a @ b.T)


def _copy_numbers(rows: np.ndarray) -> np.ndarray:
    """0, 1, .. for the first, second, .. row of every set of equal rows."""
    rows = np.ascontiguousarray(rows)
    own = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.argsort(own, kind="stable")
    out = np.empty(len(own), np.int64)
    out[order] = np.arange(len(own)) - np.searchsorted(own[order], own[order])
    return out


class ItemList:
    """The items of one model and list: a matrix in block order, centres and radii.

    ``rows`` bounds the items of a block (default ``BLOCK``)."""

    def __init__(self, X, ords, paths, block, metric: str, rows: int | None = None):
        order = np.lexsort((ords, block))
        self.ords, self.paths, block = ords[order], paths[order], block[order]
        self.metric = metric
        starts = np.r_[0, np.nonzero(np.diff(block))[0] + 1, len(block)]
        cuts = [np.arange(a, b, rows or BLOCK) for a, b in zip(starts[:-1], starts[1:])]
        self.starts = np.r_[np.concatenate(cuts), len(block)]
        # the last column makes one matrix product rank the items: squared norms for l2,
        # minus infinity for an item that has no cosine
        self.ranked = np.empty((len(order), X.shape[1] + 1))
        self.ranked[:, :-1] = X[order]
        raw = self.ranked[:, :-1]
        self.X = raw.copy() if metric == "cosine" else raw
        # of equal vectors (they share a list's order but for doc_ord) only the first k can be hits
        self.copy = np.empty(len(order), np.int64)
        by_ord = np.argsort(self.ords, kind="stable")
        self.copy[by_ord] = _copy_numbers(self.X[by_ord])
        xn2 = np.einsum("ij,ij->i", raw, raw)
        finite = np.isfinite(xn2)
        if metric == "cosine":
            raw[:] = _units(raw)
        self.ranked[:, -1] = (-0.5 * xn2 if metric == "l2" else
                              np.where(xn2 > 0, 0.0, -np.inf) if metric == "cosine" else 0.0)
        self.largest = xn2.max(initial=0.0)
        self.centres = np.stack([raw[a:b].mean(axis=0) for a, b in self.spans()])
        self.radii = np.array([np.sqrt(np.square(raw[a:b] - c).sum(axis=1).max())
                               for (a, b), c in zip(self.spans(), self.centres)]) * (1 + 1e-12)
        self.scale = 1.0 + np.einsum("ij,ij->i", raw, raw).max(initial=0.0)
        # the same in single precision, around the mean of the items for l2
        self.middle = raw[finite].mean(axis=0) if metric == "l2" and finite.any() else np.zeros(X.shape[1])
        moved = raw - self.middle
        mn2 = np.einsum("ij,ij->i", moved, moved)
        self.reach = np.sqrt(mn2[finite].max(initial=0.0))
        with np.errstate(over="ignore"):
            self.single = np.empty(self.ranked.shape, np.float32)
            self.single[:, :-1] = moved
            self.single[:, -1] = -0.5 * mn2 if metric == "l2" else self.ranked[:, -1]
        # blocks next to each other that one product scores
        sizes = np.diff(self.starts)
        self.chunks, j = [], 0
        while j < len(sizes):
            more = max(1, int(np.searchsorted(np.cumsum(sizes[j:]), max(BLOCK, CHUNK), "right")))
            self.chunks.append((j, j + more))
            j += more
        self.block = np.repeat(np.arange(len(sizes)), sizes)

    def spans(self):
        return list(zip(self.starts[:-1].tolist(), self.starts[1:].tolist()))

    def bounds(self, Q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query and block a distance that no item of the block is below, and per query
        one that about the ``k`` nearest are not above."""
        if self.metric == "dot":
            return np.full((len(Q), len(self.radii)), -np.inf), np.full(len(Q), np.inf)
        space = _units(Q) if self.metric == "cosine" else Q
        scale = self.scale + np.einsum("ij,ij->i", space, space)[:, None]
        far = np.sqrt(np.maximum(_squared(space, self.centres) - 1e-12 * scale, 0.0))
        low = np.square(np.maximum(far - self.radii, 0.0))
        high = np.square(np.where(np.diff(self.starts) < k, np.inf, far + self.radii)).min(axis=1)
        half = 2.0 if self.metric == "cosine" else 1.0
        return low / half - 1e-9 * scale, high / half

    def nearest(self, Q, k: int, round_digits: int | None):
        """(row, item, distance, rank) of the ``k`` nearest items of every row of ``Q``, sorted
        by row and rank, and the number of (query, block) pairs scored.

        Items are compared with the k-th hit so far, and only those within a small tolerance
        of it are scored exactly, so rounding never cuts a hit.  Blocks that most queries need
        are ranked together by one product in single precision, whose tolerance covers its
        rounding (double precision where that lets too many pass); hits are merged whenever
        the items seen have doubled.  A block that few queries need is scored for them alone."""
        spans, (low, high) = self.spans(), self.bounds(Q, k)
        if round_digits is not None:
            low = low - 10.0 ** -round_digits
        n, k = len(Q), min(k, len(self.ords))
        dist = np.full((n, k), np.nan)
        by = np.full((n, k), np.inf)
        item = np.full((n, k), -1, np.int64)
        scored = 0
        qn2 = np.einsum("ij,ij->i", Q, Q)
        space = _units(Q) if self.metric == "cosine" else Q
        # distance = zero - factor * product
        zero, factor = (qn2, 2.0) if self.metric == "l2" else (np.ones(n), 1.0)
        slack = 1e-9 * (1.0 + qn2 + self.largest if self.metric == "l2" else np.full(n, 2.0) if self.metric == "cosine"
                        else 1.0 + np.sqrt(qn2 * self.largest))
        if round_digits is not None:
            slack = slack + 10.0 ** -round_digits  # equal once rounded
        double = np.concatenate([space, np.ones((n, 1))], axis=1), self.ranked, zero, np.zeros(n)
        moved = space - self.middle
        mn2 = np.einsum("ij,ij->i", moved, moved)
        single = None
        if self.reach < 1e15 and (mn2 < 1e30).all():  # no square leaves single precision
            # twice the bound on the rounding of a product; sums that vanish add next to nothing
            error = 2.0 ** -23 * (Q.shape[1] + 16) * (np.sqrt(mn2) * self.reach + self.reach ** 2) + 1e-30
            single = (np.concatenate([moved, np.ones((n, 1))], axis=1).astype(np.float32), self.single,
                      mn2 if self.metric == "l2" else zero, error)

        rooms: dict = {}

        def room(kind, cells):
            if len(rooms.get(kind, ())) < cells:
                rooms[kind] = np.empty(cells, kind)
            return rooms[kind][:cells]

        def passing(own, a, b, form):
            """(row, item) pairs of the queries ``own`` and the items ``a`` to ``b`` that may be hits."""
            left, right, nought, error = form
            cells, shape = len(own) * (b - a), (len(own), b - a)
            # into memory that is there already: fresh pages cost as much as the product
            product = np.matmul(left[own], right[a:b].T, out=room(left.dtype.type, cells).reshape(shape))
            worst = by[own, -1]
            need = (nought[own] - worst - slack[own]) / factor - error[own]
            open_ = np.nonzero(np.isinf(worst))[0] if b - a > k else []  # no k hits yet: the k best of these
            if len(open_):
                kth = np.partition(np.fmax(product[open_], -np.inf), b - a - k, axis=1)[:, b - a - k]
                need[open_] = kth - slack[own[open_]] / factor - 2.0 * error[own[open_]]
            if self.metric == "cosine":
                need[qn2[own] == 0] = -np.inf  # no distance to any item: the order decides
            skip = np.less(product, need[:, None].astype(product.dtype), out=room(np.bool_, cells).reshape(shape))
            at = np.flatnonzero(np.logical_not(skip, out=skip).ravel())  # a product that is no number skips nothing
            r, c = own[at // (b - a)], at % (b - a) + a
            keep = self.copy[c] < k
            if seeded is not None:
                keep &= self.block[c] != seeded[r]
            return r[keep], c[keep]

        def merge(r, c):
            if not len(r):
                return
            d = knn._exact(Q, self.X, r, c, self.metric, qn2, self._norms())
            if round_digits is not None:
                d = np.round(d, round_digits)
            hit = np.unique(r)
            old_r, old_c = np.nonzero(item[hit] >= 0)
            own = np.concatenate([old_r, np.searchsorted(hit, r)])
            at = np.concatenate([item[hit][old_r, old_c], c])
            d = np.concatenate([dist[hit][old_r, old_c], d])
            keys = np.where(np.isnan(d), np.inf, d)
            order = np.lexsort((self.ords[at], keys, own))
            own, at, d, keys = own[order], at[order], d[order], keys[order]
            place = np.arange(len(own)) - np.searchsorted(own, np.arange(len(hit)))[own]
            best = place < k
            own, place = hit[own[best]], place[best]
            dist[own, place], by[own, place], item[own, place] = d[best], keys[best], at[best]

        waiting: list = []

        def settle():
            if waiting:
                merge(*(np.concatenate(x) for x in zip(*waiting)))
                waiting.clear()

        def score(rows, a, b, form):
            for s in range(0, len(rows), TILE):
                own = rows[s:s + TILE]
                found = passing(own, a, b, form)
                if form is not double and len(found[0]) > 8 * k * len(own):
                    found = passing(own, a, b, double)
                waiting.append(found)
                if sum(len(r) for r, _ in waiting) > MOST_WAITING:
                    settle()

        seeded = first = None
        if np.mean(low <= high[:, None]) < 0.5:  # the bounds save work: every query meets its nearest block
            first = np.argmin(np.where(np.isnan(low), np.inf, low), axis=1)
            for j in np.unique(first).tolist():
                rows = np.nonzero(first == j)[0]
                scored += len(rows)
                score(rows, *spans[j], double)
            settle()
        seeded = first
        seen = unmerged = 0
        near = np.add.reduceat(np.nan_to_num(low).sum(axis=0), [j for j, _ in self.chunks])
        for j, end in (self.chunks[i] for i in np.argsort(near / np.diff([*(x for x, _ in self.chunks), len(spans)]),
                                                          kind="stable")):
            need = ~(low[:, j:end] > by[:, -1:])  # a bound that is no number skips nothing
            inside = np.zeros(0, np.int64)
            if seeded is not None:
                inside = np.nonzero((seeded >= j) & (seeded < end))[0]
                need[inside, seeded[inside] - j] = False
            rows = np.nonzero(need.any(axis=1))[0]
            if end - j > 1 and need.sum() * SPARSE < need.size:
                for block in range(j, end):
                    own = np.nonzero(need[:, block - j] & ~(low[:, block] > by[:, -1]))[0]
                    scored += len(own)
                    score(own, *spans[block], double)
                    settle()
                continue
            scored += len(rows) * (end - j) - np.isin(inside, rows).sum()
            a, b = spans[j][0], spans[end - 1][1]
            score(rows, a, b, single or double)
            unmerged += b - a
            if unmerged >= seen:
                settle()
                seen, unmerged = seen + unmerged, 0
        settle()
        r, place = np.nonzero(item >= 0)
        return r, item[r, place], dist[r, place], place + 1, scored

    def _norms(self) -> np.ndarray | None:
        """Squared norms of the items as given, for an exact cosine."""
        if self.metric != "cosine":
            return None
        if getattr(self, "xn2", None) is None:
            self.xn2 = np.einsum("ij,ij->i", self.X, self.X)
        return self.xn2


def lists_of(table: pa.Table, metric: str, rows: int | None = None) -> dict[str, list[tuple[str | None, ItemList]]]:
    """The lists of each model of a table ``model, cat_type, doc_ord, path, vec, block``."""
    lists: dict[str, list[tuple[str | None, ItemList]]] = {}
    if not table.num_rows:
        return lists
    keys = table.select(["model", "cat_type"]).to_pandas()
    for (model, kind), at in keys.groupby(["model", "cat_type"], dropna=False).indices.items():
        part = table.take(pa.array(np.sort(at)))
        own = ItemList(_matrix(part["vec"].combine_chunks()), part["doc_ord"].to_numpy(),
                       part["path"].to_pandas().to_numpy(object), part["block"].to_numpy(), metric, rows)
        lists.setdefault(model, []).append((None if pd.isna(kind) else kind, own))
    for own in lists.values():
        own.sort(key=lambda x: (x[0] is None, x[0] or ""))
    return lists


class Items:
    """The broadcast value: Arrow buffers, decoded at first use and kept by the worker."""

    def __init__(self, table: pa.Table, metric: str):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.data, self.metric, self.decoded, self.lists = sink.getvalue().to_pybytes(), metric, 0, None

    def by_model(self) -> dict[str, list[tuple[str | None, ItemList]]]:
        if self.lists is None:
            self.lists = lists_of(pa.ipc.open_stream(self.data).read_all(), self.metric)
            self.decoded += 1
            self.data = b""
        return self.lists


def _steps(batches: Iterator[pa.RecordBatch], items: Items):
    """(lists of the model, model, uids, matrix) of at most ``BLOCK`` queries of one model."""
    lists = items.by_model()
    for b in batches:
        models = b.column("model").to_pandas()
        for model, at in models.groupby(models).indices.items():
            if model not in lists:
                continue
            for s in range(0, len(at), BLOCK):
                part = b.take(pa.array(at[s:s + BLOCK]))
                yield lists[model], model, part.column("uid").to_pandas().to_numpy(object), _matrix(part.column("vec"))


def _hits(Q, uids, model, kind, own: ItemList, k, methods, fetch_k, lam, mmr_order, round_digits):
    """Hit frames of one step and list."""
    deep = max(k, fetch_k) if "mmr" in methods else k
    r, c, d, rank, _ = own.nearest(Q, deep, round_digits)
    if "sim" in methods:
        m = rank <= k
        yield knn._frame(uids[r[m]], model, "sim", kind, rank[m], own.ords[c[m]], own.paths[c[m]], d[m], None)
    if "mmr" in methods and len(r):
        wide = min(fetch_k, len(own.ords))
        m = rank <= wide
        rows, cand, dist = r[m][::wide], c[m].reshape(-1, wide), d[m].reshape(-1, wide)
        picked = knn._mmr_chunked(Q[rows], own.X, cand, k, lam)
        n, kk = picked.shape
        step = np.argsort(picked, axis=1, kind="stable") if mmr_order == "distance" else \
            np.tile(np.arange(kk), (n, 1))
        picked = np.take_along_axis(picked, step, axis=1)
        at = np.take_along_axis(cand, picked, axis=1).ravel()
        yield knn._frame(np.repeat(uids[rows], kk), model, "mmr", kind, np.tile(np.arange(1, kk + 1), n),
                         own.ords[at], own.paths[at], np.take_along_axis(dist, picked, axis=1).ravel(),
                         (step + 1).astype(np.int32).ravel())


def with_blocks(items: DataFrame, rows_by_model: dict[str, int], metric: str, pivot_rows: int) -> DataFrame:
    """``items`` with ``block``: the number of the nearest pivot of the model, 0 without pivots.

    Pivots reach the driver: about the square root of a model's items, which are bounded
    in bytes.
    """
    share = {m: math.isqrt(n) for m, n in rows_by_model.items() if n >= pivot_rows}
    if not share:
        return items.withColumn("block", F.lit(0).cast("long"))
    every = F.create_map(*[x for m, n in share.items() for x in (F.lit(m), F.lit(n))])[F.col("model")]
    table = items.where(F.pmod(F.xxhash64("doc_ord"), every) == 0).select("model", "vec").toArrow().combine_chunks()
    pivots = {}
    for m in share:
        own = table.filter(pc.equal(table["model"], m)).combine_chunks()
        if own.num_rows:
            P = _matrix(own["vec"].combine_chunks())
            pivots[m] = _units(P) if metric == "cosine" else P
    place = items.columns.index("vec"), items.columns.index("model")
    schema = items.withColumn("block", F.lit(0).cast("long")).schema

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = np.zeros(b.num_rows, np.int64)
            models = b.column(place[1]).to_pandas()
            for m, at in models.groupby(models).indices.items():
                for s in range(0, len(at), BLOCK) if m in pivots else ():
                    own = at[s:s + BLOCK]
                    X = _matrix(b.column(place[0]).take(pa.array(own)))
                    block[own] = _squared(_units(X) if metric == "cosine" else X, pivots[m]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block)], names=[*b.schema.names, "block"])

    return items.mapInArrow(assign, schema)


def _broadcast(items: DataFrame, plan: dict, by_type: bool, metric: str, pivot_rows: int):
    kind = F.col("cat_type") if by_type else F.lit(knn.ANY_TYPE)
    own = items.select("model", kind.alias("cat_type"), "doc_ord", "path", "vec")
    table = with_blocks(own, plan["item_rows_by_model"], metric, pivot_rows).toArrow()
    return items.sparkSession.sparkContext.broadcast(Items(table, metric))


def search(queries: DataFrame, items: DataFrame, plan: dict, *, k, methods, fetch_k, lambda_mult, by_type,
           metric, mmr_order, round_digits, pivot_rows) -> DataFrame:
    """Hit lists (``knn.HIT_SCHEMA``) of prepared queries and items; see ``knn.search``."""
    shared = _broadcast(items, plan, by_type, metric, pivot_rows)
    schema = to_arrow_schema(knn.HIT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists, model, uids, Q in _steps(batches, shared.value):
            for kind, own in lists:
                for frame in _hits(Q, uids, model, kind, own, k, methods, fetch_k, lambda_mult, mmr_order,
                                   round_digits):
                    if len(frame):
                        frame["mmr_step"] = frame["mmr_step"].astype("Int32")
                        yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    return queries.mapInArrow(run, knn.HIT_SCHEMA)


def block_counts(queries: DataFrame, items: DataFrame, k: int, *, by_type: bool = True, metric: str = "l2",
                 round_digits: int | None = None, pivot_rows: int = knn.PIVOT_ROWS) -> DataFrame:
    """What the bounds save, per model and list: (query, block) pairs in all (``blocks``) and
    those scored (``scored``), by running the similarity search of ``knn.search``."""
    queries, items = knn.prepared(queries, items)
    plan = knn.block_plan(items, BLOCK)
    if plan["item_bytes"] > knn.RESIDENT_BYTES:
        raise ValueError(f"items of {plan['item_bytes']} bytes are not resident")
    shared = _broadcast(items, plan, by_type, metric, pivot_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists, model, uids, Q in _steps(batches, shared.value):
            rows = [(model, kind, len(uids) * len(own.radii), own.nearest(Q, k, round_digits)[-1])
                    for kind, own in lists]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))],
                names=["model", "cat_type", "blocks", "scored"])

    return queries.mapInArrow(run, COUNT_SCHEMA).groupBy("model", "cat_type").agg(
        F.sum("blocks").alias("blocks"), F.sum("scored").alias("scored"))
