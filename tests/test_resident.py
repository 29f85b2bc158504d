"""The search with resident items against the join forms and numpy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF0001
from taxomatch.operators import knn as K
from taxomatch.operators import resident as R

from test_knn import _brute, _frames, _got

KEYS = ("uid", "model", "method", "cat_type", "rank", "doc_ord", "path", "mmr_step")


def _rows(hits):
    return sorted([tuple(r[c] for c in KEYS) + (None if r.distance is None else round(r.distance, 9),)
                   for r in hits.collect()], key=repr)


def _clusters(spark, n=600, d=6, centres=12, seed=3):
    """Tight clusters far apart, with ties inside and across lists."""
    rng = np.random.default_rng(seed)
    C = rng.normal(size=(centres, d)) * 20
    X = C[rng.integers(0, centres, n)] + rng.normal(size=(n, d)) * 0.05
    X[50:60] = X[40]
    Q = np.concatenate([C[rng.integers(0, centres, 80)] + rng.normal(size=(80, d)) * 0.05, X[40:42],
                        rng.normal(size=(8, d)) * 20])
    it = spark.createDataFrame([("m", i, f"p{i // 2:03d}", "ALL" if i % 2 == 0 else "LAST", x.tolist())
                                for i, x in enumerate(X)],
                               "model string, doc_ord long, path string, cat_type string, vec array<double>")
    qu = spark.createDataFrame([("m", f"q{i}", x.tolist()) for i, x in enumerate(Q)],
                               "model string, uid string, vec array<double>")
    return Q, X, qu, it


@pytest.mark.parametrize("pivot_rows", [1, 1 << 30])
@pytest.mark.parametrize("by_type", [True, False])
def test_lists_equal_brute_force(spark, pivot_rows, by_type):
    for Q, X, qu, it in (_frames(spark), _clusters(spark)):
        got = _got(K.knn(qu, it, 12, by_type=by_type, pivot_rows=pivot_rows))
        assert got == _brute(Q, X, 12, by_type)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
@pytest.mark.parametrize("round_digits", [None, 2])
def test_every_metric_and_method_equals_the_join_form(spark, metric, round_digits):
    _, _, qu, it = _clusters(spark, n=300)
    zero = spark.createDataFrame([("m", 1000 + i, "zero", "ALL", [0.0] * 6) for i in range(3)], it.schema)
    it = it.unionByName(zero)                  # no cosine distance: a hit only where the list is short
    qu = qu.unionByName(spark.createDataFrame([("m", "null", [0.0] * 6), ("other", "x", [1.0] * 6)], qu.schema))
    kw = dict(methods=("sim", "mmr"), fetch_k=9, metric=metric, round_digits=round_digits)
    want = _rows(K.search(qu, it, 4, block_rows=4096, **kw))
    assert _rows(K.search(qu, it, 4, pivot_rows=1, **kw)) == want
    assert _rows(K.search(qu, it, 4, **kw)) == want
    assert {r[0] for r in want} >= {"null"} and "x" not in {r[0] for r in want}


def test_blocks_over_the_matrix_bound_are_cut(spark, monkeypatch):
    _, X, qu, it = _clusters(spark)
    own = R.ItemList(X, np.arange(len(X)), np.array(["p"] * len(X), object), np.zeros(len(X), np.int64), "l2")
    assert own.spans() == [(0, len(X))]
    monkeypatch.setattr(R, "BLOCK", 50)
    cut = R.ItemList(X, np.arange(len(X)), np.array(["p"] * len(X), object), np.zeros(len(X), np.int64), "l2")
    assert len(cut.spans()) == 12 and max(b - a for a, b in cut.spans()) == 50
    for mine, whole in zip(cut.nearest(X[:30] + 0.01, 60, None)[:4], own.nearest(X[:30] + 0.01, 60, None)[:4]):
        assert np.array_equal(mine, whole)


def test_models_of_several_widths_and_nulls(spark):
    items = [("a", i, None if i % 3 == 0 else f"p{i}", None if i % 4 == 0 else "T", [float(i), 1.0]) for i in range(30)]
    items += [("b", i, f"p{i}", "T", [float(i), 0.0, 2.0]) for i in range(30)]
    items += [(None, 1, "p", "T", [0.0]), ("a", None, "p", "T", [0.0, 0.0]), ("a", 99, "p", "T", None)]
    it = spark.createDataFrame(items, "model string, doc_ord long, path string, cat_type string, vec array<double>")
    qu = spark.createDataFrame([("a", "x", [3.2, 1.0]), ("b", "x", [7.4, 0.0, 2.0]), ("a", None, [0.0, 0.0]),
                                ("a", "none", None), (None, "y", [1.0])], "model string, uid string, vec array<double>")
    want = _rows(K.knn(qu, it, 5, block_rows=2048))
    assert _rows(K.knn(qu, it, 5, pivot_rows=1)) == want and len(want) == 15
    assert _rows(K.knn(qu, it.where("doc_ord < 0"), 5)) == []
    assert _rows(K.knn(qu.where("uid = 'z'"), it, 5)) == []


def test_bounds_skip_blocks(spark):
    """Clustered items: most blocks are skipped; the products are scored without bounds."""
    _, _, qu, it = _clusters(spark)
    for metric in ("l2", "cosine"):
        n = {(r.model, r.cat_type): (r.blocks, r.scored)
             for r in R.block_counts(qu, it, 5, metric=metric, pivot_rows=1).collect()}
        assert set(n) == {("m", "ALL"), ("m", "LAST")}
        assert all(0 < scored < 0.4 * blocks for blocks, scored in n.values()), n
    dot = R.block_counts(qu, it, 5, metric="dot", pivot_rows=1).collect()
    assert all(r.scored == r.blocks for r in dot)


def test_one_decoding_per_worker(spark):
    _, _, _, it = _clusters(spark, n=80)
    table = it.selectExpr("model", "cat_type", "doc_ord", "path", "vec", "0L AS block").toArrow()
    items = R.Items(table, "l2")
    assert items.by_model() is items.by_model() and items.decoded == 1 and items.data == b""


def test_rows_sent_to_python_are_the_queries(spark):
    plan = E.queries()["knn_topk"](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Window" not in plan
    assert plan.count("MapInArrow") == 1 and "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_items_over_the_bound_are_joined(spark, monkeypatch):
    Q, X, qu, it = _frames(spark)
    monkeypatch.setattr(K, "RESIDENT_BYTES", 100)
    hits = K.knn(qu, it, 5)
    assert "BroadcastHashJoin" in hits._jdf.queryExecution().executedPlan().toString()
    assert _got(hits) == _brute(Q, X, 5, True)
    with pytest.raises(ValueError):
        R.block_counts(qu, it, 5)


def test_few_items_are_scored_exactly(monkeypatch):
    """Without clusters no block is skipped; only what can still be a hit is scored exactly."""
    rng = np.random.default_rng(5)
    X, Q = rng.normal(size=(4000, 16)), rng.normal(size=(200, 16))
    own = R.ItemList(X, np.arange(len(X)), np.array(["p"] * len(X), object), np.arange(len(X)) % 80, "l2")
    pairs, exact = [], K._exact
    monkeypatch.setattr(K, "_exact", lambda Q, X, r, *a: pairs.append(len(r)) or exact(Q, X, r, *a))
    r, c, d, rank, scored = own.nearest(Q, 10, None)
    assert scored == 200 * 80 and sum(pairs) < 200 * 10 * 12
    want = np.argsort(np.square(Q[:, None] - X[None]).sum(axis=2), axis=1, kind="stable")[:, :10]
    assert np.array_equal(own.ords[c].reshape(200, 10), want)


def test_queries_against_many_items_are_dealt(spark, monkeypatch):
    Q, X, qu, it = _frames(spark)
    both = [d.unionByName(d.withColumn("model", F.lit("n"))) for d in (qu, it)]
    want = _rows(K.knn(*both, 5))
    size = K.block_plan(it, 2048)["item_bytes"]
    monkeypatch.setattr(K, "RESIDENT_BYTES", size)                # each model fits, both do not
    monkeypatch.setattr(K, "PIVOT_ROWS", 40)
    hits = K.knn(*both, 5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 2
    assert plan.count("RoundRobinPartitioning") == 2
    assert _rows(hits) == want


def _list(X, block, metric="l2"):
    return R.ItemList(X, np.arange(len(X)), np.array(["p"] * len(X), object), block, metric)


def _ranked(own, Q, k):
    r, c, _, rank, scored = own.nearest(Q, k, None)
    assert np.array_equal(rank, np.tile(np.arange(1, k + 1), len(Q)))
    return own.ords[c].reshape(len(Q), k), scored


def _sorted(Q, X, k):
    d = np.stack([np.square(X - q).sum(axis=1) for q in Q])
    return np.argsort(np.where(np.isnan(d), np.inf, d), axis=1, kind="stable")[:, :k]


def test_needed_blocks_share_products(monkeypatch):
    """400 blocks that all queries need: a merge per doubling of the items, not one per block."""
    rng = np.random.default_rng(8)
    X, Q = rng.normal(size=(20000, 32)), rng.normal(size=(300, 32))
    own = _list(X, np.arange(len(X)) % 400)
    calls, exact = [], K._exact
    monkeypatch.setattr(K, "_exact", lambda Q, X, r, *a: calls.append(len(r)) or exact(Q, X, r, *a))
    got, scored = _ranked(own, Q, 10)
    assert np.array_equal(got, _sorted(Q, X, 10)) and scored == 300 * 400
    assert len(calls) <= 5 and sum(calls) < 300 * 10 * 6


@pytest.mark.parametrize("offset,width", [(0.0, 1.0), (1e6, 1e-2), (0.0, 1e-12), (1e25, 1e20), (3.0, 0.0)])
def test_single_precision_cuts_no_hit(offset, width):
    """Vectors far from zero, tiny, huge or equal, ties across chunks, an outlier."""
    rng = np.random.default_rng(2)
    X = offset + width * rng.normal(size=(9000, 8))
    X[5000:5030] = X[:30]
    X[7777] = offset * 50 + 1.0
    Q = np.concatenate([offset + width * rng.normal(size=(40, 8)), X[:20]])
    got, _ = _ranked(_list(X, np.arange(len(X)) % 90), Q, 12)
    assert np.array_equal(got, _sorted(Q, X, 12))


def test_vectors_without_a_distance_hide_no_hit():
    rng = np.random.default_rng(4)
    X, Q = rng.normal(size=(9000, 8)), rng.normal(size=(30, 8))
    X[np.arange(0, 9000, 700)] = np.nan
    got, _ = _ranked(_list(X, np.arange(len(X)) // 100), Q, 10)
    assert np.array_equal(got, _sorted(Q, X, 10))


def test_copies_beyond_the_list_are_not_scored(monkeypatch):
    rng = np.random.default_rng(6)
    X, Q = rng.normal(size=(9000, 8)), rng.normal(size=(30, 8))
    X[rng.permutation(9000)[:6000]] = X[17]
    Q[:10] = X[17]
    own = _list(X, np.arange(len(X)) % 90)
    pairs, exact = [], K._exact
    monkeypatch.setattr(K, "_exact", lambda Q, X, r, *a: pairs.append(len(r)) or exact(Q, X, r, *a))
    got, _ = _ranked(own, Q, 12)
    assert np.array_equal(got, _sorted(Q, X, 12)) and sum(pairs) < 30 * 12 * 8
