"""Exact k-nearest-neighbour search (J1, L1, L2, P2, V1) and maximal marginal
relevance (L3) between a query table and an item table.

Inputs (long format, one row per vector and model):

    queries : model string, uid string, vec array<double>
    items   : model string, doc_ord long, path string, cat_type string, vec array<double>

``doc_ord`` is the tie-break order of the items (smaller first).  Every hit
carries the item's full ``path`` (J7), so no lookup join follows the search.

Rows with a null ``model``, key or vector take no part: such a query has no
hits, such an item is never one (``vec`` may hold no null elements).  A null
path or type is an ordinary value of an item.  The rule is the same in every
physical form.

Physical plan
-------------
Both sides are packed per model: the item side with a ``groupBy`` into packs of
about ``PACK_BYTES`` (pack = hash of the key, so a pack is deterministic under task
retries and its size is bounded by the row count, not by a key value; one list of
structs, so nulls never shift), the query side in place per Arrow batch.  Every
query block meets every item pack of its model in exactly one row; the worker scores
the pack in blocks of at most ``block_rows`` items, one numpy matrix product each, and
merges their lists, so only the top candidates of a pack leave it, never all pairs.
Small blocks thus cost no rows: what is sent to Python grows with the packs.
A search over many items (``PIVOT_ROWS`` of a model) is long work per query, so its
queries are first dealt evenly over the cores; else they stay where they are scanned.

* dense item side below ``RESIDENT_BYTES``: kept by the Python workers, see
  ``resident``; no join;
* item side below ``broadcast_bytes`` (the usual taxonomy): the packed item
  table (models x blocks rows) is broadcast and the query blocks stream through
  a broadcast hash join (network ~ executors x item bytes);
* all models together too large but each model small enough: one broadcast
  search per model, unioned;
* otherwise the items are cut by hash into waves below the bound; the queries
  stream past one broadcast wave after the other and the waves' top lists are
  merged.  The queries are read once per wave and neither side is replicated
  through a shuffle (network ~ executors x item bytes in all).  A small bound gives
  ``MAX_WAVES`` waves at most while those stay under ``WAVE_BYTES``: each wave is a
  join of the plan, which has to fit the driver.

With one item block per model the local lists are final and the MMR step runs
in the same pass.  With more, the local top lists are merged by a window
``row_number() <= k`` (Spark plans a partial ``WindowGroupLimit``) and MMR runs
on the merged candidates in a second Arrow pass.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxomatch.operators.rows import estimated_bytes

HIT_SCHEMA = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("cat_type", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("doc_ord", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("mmr_step", T.IntegerType()),
])

ANY_TYPE = "ANY"

# Defaults of the diversified search (fixed values of the method):
# 20 candidates are fetched, lambda = 0.5 weighs relevance against redundancy.
DEFAULT_FETCH_K = 20
DEFAULT_LAMBDA = 0.5

#: Dense items of at most this many packed bytes are kept by the Python workers.
RESIDENT_BYTES = 128 << 20
#: Packed items of at most this many bytes are broadcast by one join.
BROADCAST_BYTES = 128 << 20
#: Bytes of the items (of a model) in one row of a join, and of the queries.
PACK_BYTES = 8 << 20
#: Broadcast joins of one plan, unless the items need more of ``WAVE_BYTES``.
MAX_WAVES = 8
WAVE_BYTES = 64 << 20
#: Queries of one partition when they are dealt.
DEAL_BYTES = 16 << 20
#: Items of a model from which on they lie in blocks around pivots.
PIVOT_ROWS = 4096


# --------------------------------------------------------------------------- numpy kernels

def mmr_select(q: np.ndarray, cands: np.ndarray, k: int, lambda_mult: float) -> np.ndarray:
    """Batched greedy MMR.

    q: (n, d) query vectors; cands: (n, m, d) candidates in distance order.
    Returns (n, min(k, m)) candidate positions in selection order.  Cosine is
    used for both terms, a zero norm gives similarity 0, the first pick is the
    most similar candidate and on equal scores the earlier candidate wins.
    """
    n, m, _ = cands.shape
    kk = min(k, m)
    if n == 0 or kk == 0:
        return np.zeros((n, 0), dtype=np.int64)
    qn = np.linalg.norm(q, axis=1)
    cn = np.linalg.norm(cands, axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        sim_q = np.einsum("nd,nmd->nm", q, cands) / (qn[:, None] * cn)
        sim_c = np.einsum("nid,njd->nij", cands, cands) / (cn[:, :, None] * cn[:, None, :])
    sim_q[~np.isfinite(sim_q)] = 0.0
    sim_c[~np.isfinite(sim_c)] = 0.0
    rows = np.arange(n)
    sel = np.zeros((n, kk), dtype=np.int64)
    first = np.argmax(sim_q, axis=1)
    sel[:, 0] = first
    chosen = np.zeros((n, m), dtype=bool)
    chosen[rows, first] = True
    redundancy = sim_c[rows, :, first]
    for s in range(1, kk):
        score = lambda_mult * sim_q - (1.0 - lambda_mult) * redundancy
        score[chosen] = -np.inf
        j = np.argmax(score, axis=1)
        sel[:, s] = j
        chosen[rows, j] = True
        redundancy = np.maximum(redundancy, sim_c[rows, :, j])
    return sel


def _top_candidates(Q, Xg, og, kcand, metric, round_digits=None):
    """Exact top ``kcand`` items of ``Xg`` for every row of ``Q``.

    The matrix product ranks approximately; every item within a small
    tolerance of the k-th value is re-scored exactly, so ties and rounding
    never cut a true neighbour.  Returns (row, col, dist, rank) sorted by row,
    then (dist, doc_ord).
    """
    nq = Q.shape[0]
    n = Xg.shape[0]
    kk = min(kcand, n)
    qn2 = np.einsum("ij,ij->i", Q, Q)
    xn2 = np.einsum("ij,ij->i", Xg, Xg)
    if metric == "l2":
        approx = qn2[:, None] + xn2[None, :] - 2.0 * (Q @ Xg.T)
        scale = 1.0 + qn2[:, None] + xn2.max(initial=0.0)
    elif metric == "dot":
        approx = 1.0 - Q @ Xg.T
        scale = 1.0 + np.sqrt(qn2)[:, None] * np.sqrt(xn2.max(initial=0.0))
    else:
        qn = np.sqrt(qn2)
        xn = np.sqrt(xn2)
        with np.errstate(divide="ignore", invalid="ignore"):
            approx = 1.0 - (Q @ Xg.T) / np.outer(qn, xn)
        approx[~np.isfinite(approx)] = np.inf
        scale = np.full((nq, 1), 2.0)
    if kk < n:
        kth = np.partition(approx, kk - 1, axis=1)[:, kk - 1:kk]
        tol = 1e-9 * scale + (0.0 if round_digits is None else 10.0 ** -round_digits)  # equal once rounded
        r, c = np.nonzero(approx <= kth + tol)
    else:
        r, c = np.nonzero(np.ones_like(approx, dtype=bool))
    d = _exact(Q, Xg, r, c, metric, qn2, xn2)
    if round_digits is not None:
        d = np.round(d, round_digits)
    order = np.lexsort((og[c], np.where(np.isnan(d), np.inf, d), r))
    r, c, d = r[order], c[order], d[order]
    if len(r) == 0:
        return r, c, d, np.zeros(0, dtype=np.int64)
    starts = np.r_[0, np.nonzero(np.diff(r))[0] + 1]
    lengths = np.diff(np.r_[starts, len(r)])
    rank = np.arange(len(r)) - np.repeat(starts, lengths) + 1
    keep = rank <= kk
    return r[keep], c[keep], d[keep], rank[keep]


# Bytes of the temporary (pairs x dim) arrays of one step in the Python worker.
_CHUNK_BYTES = 16 << 20
_PAIR_BYTES = 512 << 10


def _exact(Q, Xg, r, c, metric, qn2, xn2):
    """Exact distance of the (row r, item c) pairs, in chunks of ~512 kB that stay in the cache."""
    out = np.empty(len(r))
    step = max(1, _PAIR_BYTES // (8 * max(1, Q.shape[1])))
    for s in range(0, len(r), step):
        rr, cc = r[s:s + step], c[s:s + step]
        if metric == "l2":
            diff = Q[rr] - Xg[cc]
            out[s:s + step] = np.einsum("ij,ij->i", diff, diff)
        elif metric == "dot":
            out[s:s + step] = 1.0 - np.einsum("ij,ij->i", Q[rr], Xg[cc])
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                out[s:s + step] = 1.0 - np.einsum("ij,ij->i", Q[rr], Xg[cc]) / (
                    np.sqrt(qn2[rr]) * np.sqrt(xn2[cc]))
    if metric == "cosine":
        out[~np.isfinite(out)] = np.nan
    return out


def _mmr_chunked(Q, Xg, cand, k, lam):
    """``mmr_select`` over query chunks so (queries x candidates x dim) stays ~16 MB."""
    nq, mf = cand.shape
    step = max(1, _CHUNK_BYTES // (8 * max(1, mf * Q.shape[1])))
    parts = [mmr_select(Q[s:s + step], Xg[cand[s:s + step]], k, lam) for s in range(0, nq, step)]
    return np.concatenate(parts) if parts else np.zeros((0, min(k, mf)), dtype=np.int64)


def _frame(uids, model, method, ctype, rank, ords, paths, dist, step):
    n = len(rank)
    return pd.DataFrame({
        "uid": uids,
        "model": np.full(n, model, dtype=object),
        "method": np.full(n, method, dtype=object),
        "cat_type": np.full(n, ctype, dtype=object),
        "rank": rank.astype(np.int32),
        "doc_ord": ords.astype(np.int64),
        "path": paths,
        "distance": dist.astype(np.float64),
        "mmr_step": step,
    })


def _dense(vecs) -> np.ndarray:
    return np.asarray(np.stack(vecs), dtype=np.float64) if len(vecs) else np.zeros((0, 1))


def _dense_sparse(idx_list, val_list, dim: int) -> np.ndarray:
    """Rows given as (indices, values) -> one dense (n, dim) block."""
    n = len(idx_list)
    m = np.zeros((n, dim))
    if n:
        lens = np.fromiter((len(i) for i in idx_list), dtype=np.int64, count=n)
        if lens.sum():
            rows = np.repeat(np.arange(n), lens)
            m[rows, np.concatenate([np.asarray(i, dtype=np.int64) for i in idx_list])] = \
                np.concatenate([np.asarray(v, dtype=np.float64) for v in val_list])
    return m


def _sparse_block(row):
    """(product matrix, squared norms of both sides) of sparse rows, from their
    non-zero terms only: every query term meets its postings in the item block."""
    def flat(idx_list, val_list):
        lens = np.fromiter((len(i) for i in idx_list), dtype=np.int64, count=len(idx_list))
        owner = np.repeat(np.arange(len(lens)), lens)
        if not len(owner):
            return owner, np.zeros(0, np.int64), np.zeros(0)
        return (owner, np.concatenate([np.asarray(i, dtype=np.int64) for i in idx_list]),
                np.concatenate([np.asarray(v, dtype=np.float64) for v in val_list]))

    nq, n = len(row.q_idx), len(row.i_idx)
    qo, qt, qv = flat(row.q_idx, row.q_val)
    xo, xt, xv = flat(row.i_idx, row.i_val)
    qn2, xn2 = np.bincount(qo, qv * qv, nq), np.bincount(xo, xv * xv, n)
    by_term = np.argsort(xt, kind="stable")
    xo, xt, xv = xo[by_term], xt[by_term], xv[by_term]
    lo, hi = np.searchsorted(xt, qt, "left"), np.searchsorted(xt, qt, "right")
    out = np.zeros(nq * n)
    done = 0
    ends = np.cumsum(hi - lo)
    while done < len(qt):  # ~16 MB of pairs at a time
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (_CHUNK_BYTES >> 4))))
        count = (hi - lo)[done:stop]
        which = np.repeat(np.arange(done, min(stop, len(qt))), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[which]
        out += np.bincount(qo[which] * n + xo[at], qv[which] * xv[at], nq * n)
        done = stop
    return out.reshape(nq, n), qn2, xn2


def _top_of_product(dots, qn2, xn2, og, kcand, metric, round_digits=None):
    """Like ``_top_candidates``, from the products of all pairs of a block."""
    if metric == "l2":
        d = qn2[:, None] + xn2[None, :] - 2.0 * dots
    elif metric == "dot":
        d = 1.0 - dots
    else:
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 1.0 - dots / np.sqrt(np.outer(qn2, xn2))
        d[~np.isfinite(d)] = np.nan
    if round_digits is not None:
        d = np.round(d, round_digits)
    rank_by = np.where(np.isnan(d), np.inf, d)
    kk = min(kcand, d.shape[1])
    kth = np.partition(rank_by, kk - 1, axis=1)[:, kk - 1:kk]
    r, c = np.nonzero(rank_by <= kth)
    order = np.lexsort((og[c], rank_by[r, c], r))
    r, c = r[order], c[order]
    starts = np.searchsorted(r, np.arange(d.shape[0]))
    rank = np.arange(len(r)) - starts[r] + 1
    keep = rank <= kk
    return r[keep], c[keep], d[r, c][keep], rank[keep]


def _type_groups(types, by_type):
    if not by_type:
        return [(ANY_TYPE, np.arange(len(types)))]
    return [(t, np.nonzero(types == t)[0]) for t in sorted(
        set(types.tolist()), key=lambda t: (t is None, t or ""))]


def _score_pack(row, k, methods, fetch_k, lam, metric, by_type, mmr_order, round_digits, block_rows):
    """Dense queries and items of one row, scored in blocks of ``block_rows`` items."""
    from taxomatch.operators import resident  # it builds on this module

    Q, X = _dense(row.q_vec), _dense(row.i_vec)
    uids = np.asarray(row.q_uid, dtype=object)
    ords = np.asarray(row.i_ord, dtype=np.int64)
    paths = np.asarray(row.i_path, dtype=object)
    for ctype, idx in _type_groups(np.asarray(row.i_type, dtype=object), by_type):
        own = resident.ItemList(X[idx], ords[idx], paths[idx], np.zeros(len(idx), np.int64), metric, block_rows)
        for s in range(0, len(Q), resident.BLOCK):
            yield from resident._hits(Q[s:s + resident.BLOCK], uids[s:s + resident.BLOCK], row.model, ctype, own, k,
                                      methods, fetch_k, lam, mmr_order, round_digits)


def _score_block(row, k, methods, fetch_k, lam, metric, by_type, mmr_order, round_digits,
                 sparse_dim):
    """The same of sparse vectors; a row holds one block of items."""
    terms_only = "mmr" not in methods
    if terms_only:
        dots, qn2, xn2 = _sparse_block(row)
    else:
        Q = _dense_sparse(row.q_idx, row.q_val, sparse_dim)
        X = _dense_sparse(row.i_idx, row.i_val, sparse_dim)
    uids = np.asarray(row.q_uid, dtype=object)
    ords = np.asarray(row.i_ord, dtype=np.int64)
    paths = np.asarray(row.i_path, dtype=object)
    types = np.asarray(row.i_type, dtype=object)
    groups = _type_groups(types, by_type)
    want_mmr = "mmr" in methods
    kcand = max(k, fetch_k) if want_mmr else k
    out = []
    for ctype, idx in groups:
        og, pg = ords[idx], paths[idx]
        if terms_only:
            r, c, d, rank = _top_of_product(dots[:, idx], qn2, xn2[idx], og, kcand, metric, round_digits)
        else:
            Xg = X[idx]
            r, c, d, rank = _top_candidates(Q, Xg, og, kcand, metric, round_digits)
        if "sim" in methods:
            m = rank <= k
            out.append(_frame(uids[r[m]], row.model, "sim", ctype, rank[m], og[c[m]], pg[c[m]],
                              d[m], None))
        if want_mmr and len(r):
            mf = min(fetch_k, len(idx))
            m = rank <= mf
            rr, cc, dd = r[m], c[m], d[m]
            nq = len(rr) // mf
            cand = cc.reshape(nq, mf)
            qrows = rr.reshape(nq, mf)[:, 0]
            sel = _mmr_chunked(Q[qrows], Xg, cand, k, lam)
            kk = sel.shape[1]
            step = np.tile(np.arange(1, kk + 1, dtype=np.int32), nq)
            if mmr_order == "distance":
                srt = np.sort(sel, axis=1)
                # selection step of each emitted candidate
                pos = np.argsort(sel, axis=1, kind="stable")
                step = (pos + 1).astype(np.int32).ravel()
                sel = srt
            rank_m = np.tile(np.arange(1, kk + 1, dtype=np.int32), nq)
            picked = cand[np.arange(nq)[:, None], sel].ravel()
            dist = dd.reshape(nq, mf)[np.arange(nq)[:, None], sel].ravel()
            out.append(_frame(np.repeat(uids[qrows], kk), row.model, "mmr", ctype, rank_m,
                              og[picked], pg[picked], dist, step))
    return out


def _block_kernel(k, methods, fetch_k, lam, metric, by_type, mmr_order, round_digits=None,
                  sparse_dim=None, block_rows=None):
    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if sparse_dim:
                    parts = _score_block(row, k, methods, fetch_k, lam, metric, by_type, mmr_order,
                                         round_digits, sparse_dim)
                else:
                    parts = _score_pack(row, k, methods, fetch_k, lam, metric, by_type, mmr_order,
                                        round_digits, block_rows)
                for res in parts:
                    if len(res):
                        res["mmr_step"] = res["mmr_step"].astype("Int32")
                        yield res
    return run


def _mmr_kernel(k, lam, mmr_order, sparse_dim=None):
    """Candidate lists of one length are selected together, in chunks of ~16 MB."""
    def run(batches):
        for pdf in batches:
            parts = []
            for m, g in pdf.groupby(pdf["cands"].map(len), sort=True):
                if sparse_dim:
                    width = sparse_dim
                    Q = _dense_sparse(g["q_idx"].tolist(), g["q_val"].tolist(), sparse_dim)
                else:
                    Q = _dense(g["q_vec"].tolist())
                    width = Q.shape[1]
                step = max(1, _CHUNK_BYTES // (8 * max(1, m * width)))
                for s in range(0, len(g), step):
                    part, q = g.iloc[s:s + step], Q[s:s + step]
                    flat = [c for cands in part["cands"] for c in cands]
                    if sparse_dim:
                        C = _dense_sparse([c["idx"] for c in flat], [c["val"] for c in flat], sparse_dim)
                    else:
                        C = _dense([c["vec"] for c in flat])
                    sel = mmr_select(q, C.reshape(len(part), m, -1), k, lam)
                    kk = sel.shape[1]
                    order = np.argsort(sel, axis=1, kind="stable") if mmr_order == "distance" else \
                        np.tile(np.arange(kk), (len(part), 1))
                    sel = np.take_along_axis(sel, order, axis=1)
                    picked = [flat[i] for i in (np.arange(len(part))[:, None] * m + sel).ravel()]
                    parts.append(pd.DataFrame({
                        "uid": np.repeat(part["uid"].to_numpy(), kk),
                        "model": np.repeat(part["model"].to_numpy(), kk),
                        "method": "mmr",
                        "cat_type": np.repeat(part["cat_type"].to_numpy(), kk),
                        "rank": np.tile(np.arange(1, kk + 1, dtype=np.int32), len(part)),
                        "doc_ord": [c["doc_ord"] for c in picked],
                        "path": [c["path"] for c in picked],
                        "distance": [c["distance"] for c in picked],
                        "mmr_step": (order + 1).astype(np.int32).ravel(),
                    }))
            if parts:
                res = pd.concat(parts, ignore_index=True)
                res["mmr_step"] = res["mmr_step"].astype("Int32")
                yield res
    return run


# --------------------------------------------------------------------------- planning

def _with_model(df: DataFrame) -> DataFrame:
    return df if "model" in df.columns else df.withColumn("model", F.lit("default"))


def _vec_cols(sparse_dim):
    if sparse_dim:
        return [F.col("idx").cast("array<int>").alias("idx"), F.col("val").cast("array<double>").alias("val")]
    return [F.col("vec").cast("array<double>").alias("vec")]


def block_plan(items: DataFrame, block_rows: int, sparse_dim: int | None = None,
               block_bytes: int = 32 << 20) -> dict:
    """Sizes that decide the physical form.

    One small job gives per-model row counts and packed bytes (vectors and
    paths) of the item side; one row per model reaches the driver.  The query
    side is never counted.  A block holds at most ``block_rows`` vectors and
    about ``block_bytes`` bytes.
    """
    width = (F.size("idx") * 12 + 64) if sparse_dim else (F.size("vec") * 8 + 64)
    width = width + F.coalesce(F.octet_length("path"), F.lit(0)) + F.coalesce(F.octet_length("cat_type"), F.lit(0))
    rows = items.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).collect()
    by_model = {r["model"]: int(r["bytes"] or 0) for r in rows}
    return {
        "item_blocks": max([1] + [math.ceil(max(r["n"] / block_rows, (r["bytes"] or 0) / block_bytes))
                                  for r in rows]),
        "item_bytes": sum(by_model.values()),
        "item_bytes_by_model": by_model,
        "item_rows_by_model": {r["model"]: r["n"] for r in rows},
    }


def prepared(queries: DataFrame, items: DataFrame, sparse_dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns and types of a search; rows that take no part are left out."""
    queries = _with_model(queries).select("model", F.col("uid").cast("string").alias("uid"),
                                          *_vec_cols(sparse_dim))
    items = _with_model(items).select("model", F.col("doc_ord").cast("long").alias("doc_ord"),
                                      "path", "cat_type", *_vec_cols(sparse_dim))
    present = [F.col(c).isNotNull() for c in (["model", "idx", "val"] if sparse_dim else ["model", "vec"])]
    return (queries.where(reduce(lambda a, b: a & b, present) & F.col("uid").isNotNull()),
            items.where(reduce(lambda a, b: a & b, present) & F.col("doc_ord").isNotNull()))


def search(queries: DataFrame, items: DataFrame, k: int, *, methods=("sim",),
           fetch_k: int = DEFAULT_FETCH_K, lambda_mult: float = DEFAULT_LAMBDA,
           by_type: bool = True, metric: str = "l2", mmr_order: str = "distance",
           block_rows: int | None = None, broadcast_bytes: int | None = None,
           round_digits: int | None = None, sparse_dim: int | None = None,
           plan: dict | None = None, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """Hit lists for every (query, model, list) - one row per hit (``HIT_SCHEMA``).

    ``methods``: ``sim`` = k nearest (J1/L2), ``mmr`` = diversified top k (L3).
    ``by_type``: one list per ``cat_type`` of the items (P2); otherwise one list
    over all items with ``cat_type = 'ANY'`` (Q2).
    ``metric``: ``l2`` (squared Euclidean, smaller is nearer), ``cosine``
    (``distance = 1 - cos``) or ``dot`` (``distance = 1 - q.x``, for vectors
    normalised beforehand).  Ties go to the smaller ``doc_ord``;
    ``round_digits`` rounds distances before ranking so that sums taken in
    another order tie the same way.
    ``sparse_dim``: vectors come as ``idx array<int>`` / ``val array<double>``
    columns of that dimension (e.g. TF-IDF); similarity lists are scored on the
    non-zero terms, MMR on blocks of at most 64 MB dense.

    Dense items of at most ``RESIDENT_BYTES`` (counted) stay in the Python workers
    (``resident``; ``pivot_rows``: items of a model from which on blocks are skipped
    by pivots; several models whose sum is larger: one search each), unless the caller
    sizes a join with ``block_rows`` (2048), ``broadcast_bytes`` (``BROADCAST_BYTES``)
    or ``plan``.

    Join form: all item blocks broadcast when their packed size is at most
    ``broadcast_bytes``; else, when every model alone fits, one broadcast
    search per model (a union); else the items in waves under the bound.
    """
    if metric not in ("l2", "cosine", "dot"):
        raise ValueError(metric)
    join_sized = (block_rows, broadcast_bytes, plan) != (None, None, None)
    block_rows = 2048 if block_rows is None else block_rows
    broadcast_bytes = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    if sparse_dim and "mmr" in methods:  # dense blocks; else the non-zero terms are scored
        block_rows = min(block_rows, max(1, (64 << 20) // (8 * sparse_dim)))
    queries, items = prepared(queries, items, sparse_dim)
    plan = plan or block_plan(items, block_rows, sparse_dim)
    opts = dict(k=k, methods=methods, fetch_k=fetch_k, lambda_mult=lambda_mult, by_type=by_type,
                metric=metric, mmr_order=mmr_order, round_digits=round_digits)
    by_model = plan.get("item_bytes_by_model") or {}
    if not (join_sized or sparse_dim) and max([0, *by_model.values()]) <= RESIDENT_BYTES and \
            plan["item_bytes"] <= 4 * RESIDENT_BYTES:
        from taxomatch.operators import resident  # it builds on this module

        one = lambda q, i: resident.search(_dealt(q, plan), i, plan, pivot_rows=pivot_rows, **opts)
        if plan["item_bytes"] <= RESIDENT_BYTES:
            return one(queries, items)
        return reduce(DataFrame.unionByName, [one(queries.where(F.col("model") == m), items.where(F.col("model") == m))
                                              for m in sorted(by_model)])
    queries = _dealt(queries, plan)
    opts.update(sparse_dim=sparse_dim, block_rows=block_rows)
    if plan["item_bytes"] > broadcast_bytes and len(by_model) > 1 and \
            max(by_model.values()) <= broadcast_bytes:
        parts = [_search_blocks(queries.where(F.col("model") == m), items.where(F.col("model") == m),
                                plan, 1, **opts) for m in sorted(by_model)]
        return reduce(lambda a, b: a.unionByName(b), parts)
    # a wave holds at least one block, which is small enough for any broadcast
    waves = min(plan["item_blocks"], max(1, math.ceil(plan["item_bytes"] / max(1, broadcast_bytes))))
    waves = min(waves, max(MAX_WAVES, math.ceil(plan["item_bytes"] / WAVE_BYTES)))
    return _search_blocks(queries, items, plan, waves, **opts)


def _dealt(queries: DataFrame, plan: dict) -> DataFrame:
    """The queries in even partitions when many items make the work of each of them long."""
    if max([0, *(plan.get("item_rows_by_model") or {}).values()]) < PIVOT_ROWS:
        return queries
    cores = queries.sparkSession.sparkContext.defaultParallelism
    size = estimated_bytes(queries) or 0
    # a plan without statistics claims more than any table has
    return queries.repartition(max(4 * cores, size // DEAL_BYTES if size < 1 << 50 else 0))


def _model_key(row_col: str):
    """``model`` as a join key derived from the row.

    With one model given as a literal on both sides the optimizer would fold
    ``model = model`` to true and plan a nested-loop (cross) join; appending an
    empty substring of a row column keeps it an equi-join.
    """
    return F.concat(F.col("model"), F.coalesce(F.substring(F.col(row_col).cast("string"), 1, 0), F.lit("")))


def _local_packer(vcols, block_rows, block_bytes=PACK_BYTES):
    """mapInPandas function: pack the query rows of each Arrow batch into
    blocks (per model, ~``block_bytes``; of sparse rows at most ``block_rows``) where
    they are - a narrow step, no shuffle."""
    def run(batches):
        for pdf in batches:
            rows = []
            for model, g in pdf.groupby("model", sort=False):
                step = block_rows
                if "vec" in vcols and len(g):
                    d = len(g["vec"].iloc[0])
                    step = max(1, block_bytes // (8 * d + 64))
                for s in range(0, len(g), step):
                    part = g.iloc[s:s + step]
                    row = {"_mk": model, "model": model, "q_uid": part["uid"].tolist()}
                    for c in vcols:
                        row[f"q_{c}"] = [np.asarray(v) for v in part[c]]
                    rows.append(row)
            if rows:
                yield pd.DataFrame(rows)
    return run


def _packed_query_schema(vcols) -> str:
    cols = ["_mk string", "model string", "q_uid array<string>"]
    if "vec" in vcols:
        cols.append("q_vec array<array<double>>")
    else:
        cols += ["q_idx array<array<int>>", "q_val array<array<double>>"]
    return ", ".join(cols)


def _search_blocks(queries, items, plan, waves, *, k, methods, fetch_k, lambda_mult, by_type,
                   metric, mmr_order, round_digits, sparse_dim, block_rows):
    vcols = ["idx", "val"] if sparse_dim else ["vec"]
    packs = plan["item_blocks"]
    if not sparse_dim:  # a pack has several blocks
        most = max((plan.get("item_bytes_by_model") or {}).values(), default=plan["item_bytes"])
        packs = min(packs, max(1, math.ceil(most / PACK_BYTES)))
    # packs of a wave; a wave of several is one more cut by the same hash
    ni = -(-packs // waves) * waves
    packed = ["doc_ord", "path", "cat_type", *vcols]
    names = ["ord", "path", "type", *vcols]
    ipack = (items.withColumn("ib", F.pmod(F.xxhash64("doc_ord"), F.lit(ni)))
             .withColumn("_mk", _model_key("doc_ord"))
             .groupBy("_mk", "ib").agg(F.collect_list(F.struct(*packed)).alias("s"))
             .select("_mk", "ib", *[F.col(f"s.{c}").alias(f"i_{n}") for c, n in zip(packed, names)]))
    qpack = queries.mapInPandas(_local_packer(vcols, block_rows), _packed_query_schema(vcols))
    pairs = [qpack.join(F.broadcast(ipack.where(F.col("ib") % waves == w) if waves > 1 else ipack), "_mk")
             for w in range(waves)]
    pairs = reduce(lambda a, b: a.unionByName(b), pairs)

    final = plan["item_blocks"] == 1
    kernel_methods = tuple(methods) if final else ("sim",)
    kcand = k if (final or "mmr" not in methods) else max(k, fetch_k)
    hits = pairs.mapInPandas(
        _block_kernel(kcand if not final else k, kernel_methods, fetch_k, lambda_mult, metric,
                      by_type, mmr_order, round_digits, sparse_dim, block_rows),
        HIT_SCHEMA)
    if final:
        return hits

    w = Window.partitionBy("uid", "model", "cat_type").orderBy(
        F.col("distance").asc_nulls_last(), "doc_ord")
    cand = (hits.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= kcand))
    out = cand.where(F.col("rank") <= k) if "sim" in methods else None
    if "mmr" in methods:
        mm = mmr_from_candidates(cand.where(F.col("rank") <= fetch_k), queries, items, k,
                                 lambda_mult, mmr_order, sparse_dim)
        out = mm if out is None else out.unionByName(mm)
    return out


def mmr_from_candidates(cand: DataFrame, queries: DataFrame, items: DataFrame, k: int,
                        lambda_mult: float = DEFAULT_LAMBDA, mmr_order: str = "distance",
                        sparse_dim: int | None = None) -> DataFrame:
    """L3 on given candidate lists (rows uid, model, cat_type, rank, doc_ord, path, distance).

    Candidates of one list are packed into one row (at most ``fetch_k``), the
    vectors are joined back on ``(model, doc_ord)`` and ``(model, uid)``.
    """
    vcols = ["idx", "val"] if sparse_dim else ["vec"]
    iv = items.select("model", "doc_ord", *vcols)
    qv = queries.select("model", "uid", *[F.col(c).alias(f"q_{c}") for c in vcols])
    packed = (cand.select("uid", "model", "cat_type", "rank", "doc_ord", "path", "distance")
              .join(iv, ["model", "doc_ord"])
              .groupBy("uid", "model", "cat_type")
              .agg(F.array_sort(F.collect_list(
                  F.struct("rank", "doc_ord", "path", "distance", *vcols))).alias("cands"))
              .join(qv, ["model", "uid"]))
    return packed.mapInPandas(_mmr_kernel(k, lambda_mult, mmr_order, sparse_dim), HIT_SCHEMA)


def knn(queries: DataFrame, items: DataFrame, k: int, **kw) -> DataFrame:
    """k nearest items per query (and per ``cat_type`` unless ``by_type=False``)."""
    return search(queries, items, k, methods=("sim",), **kw)


def nearest(queries: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """L1: the single nearest item over all types."""
    kw.setdefault("by_type", False)
    return search(queries, items, 1, methods=("sim",), **kw)
