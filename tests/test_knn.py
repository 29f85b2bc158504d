"""k-NN and MMR against numpy brute force, on every physical form."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxomatch.operators import knn as K


def _frames(spark, seed=0, nq=60, ni=40, d=8, ties=True):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(ni, d))
    if ties and ni > 22:
        X[6] = X[4]          # identical items of one type (exact distance tie)
        X[7] = X[5]
        X[22] = X[20]
        X[9] = X[4]          # and across types
    Q = rng.normal(size=(nq, d))
    Q[0] = X[4]              # a query sitting on a duplicated item
    items = [("m", i, f"p{i // 2:03d}", "ALL" if i % 2 == 0 else "LAST", X[i].tolist()) for i in range(ni)]
    queries = [("m", f"q{j}", Q[j].tolist()) for j in range(nq)]
    it = spark.createDataFrame(items, "model string, doc_ord long, path string, cat_type string, vec array<double>")
    qu = spark.createDataFrame(queries, "model string, uid string, vec array<double>")
    return Q, X, qu, it


def _brute(Q, X, k, by_type, metric="l2"):
    out = {}
    types = np.array(["ALL" if i % 2 == 0 else "LAST" for i in range(len(X))])
    groups = [("ALL", np.nonzero(types == "ALL")[0]), ("LAST", np.nonzero(types == "LAST")[0])] if by_type \
        else [("ANY", np.arange(len(X)))]
    for j, q in enumerate(Q):
        for t, idx in groups:
            if metric == "l2":
                d = ((X[idx] - q) ** 2).sum(1)
            else:
                d = 1 - X[idx] @ q / (np.linalg.norm(X[idx], axis=1) * np.linalg.norm(q))
            order = sorted(range(len(idx)), key=lambda i: (round(d[i], 12), idx[i]))[:k]
            out[(f"q{j}", t)] = [int(idx[i]) for i in order]
    return out


def _got(hits):
    out = {}
    for r in hits.collect():
        out.setdefault((r.uid, r.cat_type), []).append((r.rank, r.doc_ord))
    return {key: [o for _, o in sorted(v)] for key, v in out.items()}


@pytest.mark.parametrize("block_rows,broadcast_bytes", [(4096, 1 << 30), (7, 1 << 30), (7, 0), (7, 900), (4096, 0)])
@pytest.mark.parametrize("by_type", [True, False])
def test_knn_matches_brute_force(spark, block_rows, broadcast_bytes, by_type):
    Q, X, qu, it = _frames(spark)
    hits = K.knn(qu, it, 5, by_type=by_type, block_rows=block_rows, broadcast_bytes=broadcast_bytes)
    assert _got(hits) == _brute(Q, X, 5, by_type)


def test_knn_cosine(spark):
    Q, X, qu, it = _frames(spark, seed=3, ties=False)
    hits = K.knn(qu, it, 4, metric="cosine")
    assert _got(hits) == _brute(Q, X, 4, True, metric="cosine")
    r = hits.where("uid = 'q1' AND rank = 1 AND cat_type = 'ALL'").first()
    i = r.doc_ord
    assert math.isclose(r.distance, 1 - X[i] @ Q[1] / (np.linalg.norm(X[i]) * np.linalg.norm(Q[1])), rel_tol=1e-12)


def test_distance_is_exact_squared_l2(spark):
    Q, X, qu, it = _frames(spark, seed=5, ties=False)
    for r in K.nearest(qu, it).collect():
        j = int(r.uid[1:])
        assert math.isclose(r.distance, float(((X[r.doc_ord] - Q[j]) ** 2).sum()), rel_tol=1e-12)


def test_result_independent_of_partitioning(spark):
    Q, X, qu, it = _frames(spark, seed=7)
    a = _got(K.knn(qu, it, 3))
    b = _got(K.knn(qu.repartition(13), it.repartition(5), 3, block_rows=5))
    assert a == b


def test_k_larger_than_items(spark):
    Q, X, qu, it = _frames(spark, nq=3, ni=6)
    got = _got(K.knn(qu, it, 10))
    assert all(len(v) == 3 for v in got.values())


def _mmr_reference(q, C, k, lam):
    """Plain greedy loop, written independently of the batched kernel."""
    def cos(a, b):
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        return 0.0 if na == 0 or nb == 0 else float(a @ b / (na * nb))
    sim_q = [cos(q, c) for c in C]
    sel = [int(np.argmax(sim_q))]
    while len(sel) < min(k, len(C)):
        best, pick = -np.inf, -1
        for i in range(len(C)):
            if i in sel:
                continue
            s = lam * sim_q[i] - (1 - lam) * max(cos(C[i], C[j]) for j in sel)
            if s > best:
                best, pick = s, i
        sel.append(pick)
    return sel


def test_mmr_two_dimensional_example():
    def u(deg):
        r = math.radians(deg)
        return np.array([math.cos(r), math.sin(r)])
    q = u(0)[None, :]
    C = np.stack([u(10), u(12), u(-60)])[None, :, :]
    assert K.mmr_select(q, C, 2, 0.5)[0].tolist() == [0, 2]


def test_mmr_batched_equals_loop():
    rng = np.random.default_rng(11)
    q = rng.normal(size=(30, 6))
    C = rng.normal(size=(30, 12, 6))
    C[:, 3] = 0.0                                   # zero vector: similarity 0
    got = K.mmr_select(q, C, 5, 0.5)
    for n in range(30):
        assert got[n].tolist() == _mmr_reference(q[n], C[n], 5, 0.5)


@pytest.mark.parametrize("block_rows", [4096, 9])
def test_mmr_lists_in_spark(spark, block_rows):
    Q, X, qu, it = _frames(spark, seed=2, nq=20, ni=60, ties=False)
    hits = K.search(qu, it, 4, methods=("mmr",), fetch_k=10, block_rows=block_rows)
    rows = hits.collect()
    types = np.array(["ALL" if i % 2 == 0 else "LAST" for i in range(len(X))])
    for j in range(20):
        for t in ("ALL", "LAST"):
            idx = np.nonzero(types == t)[0]
            d = ((X[idx] - Q[j]) ** 2).sum(1)
            cand = idx[np.argsort(d, kind="stable")[:10]]
            sel = _mmr_reference(Q[j], X[cand], 4, 0.5)
            want = [int(cand[i]) for i in sorted(sel)]             # distance order
            got = [r.doc_ord for r in sorted((r for r in rows if r.uid == f"q{j}" and r.cat_type == t),
                                             key=lambda r: r.rank)]
            assert got == want
            steps = {r.doc_ord: r.mmr_step for r in rows if r.uid == f"q{j}" and r.cat_type == t}
            assert [steps[int(cand[i])] for i in sel] == [1, 2, 3, 4]


def test_sim_and_mmr_in_one_pass(spark):
    Q, X, qu, it = _frames(spark, seed=4, nq=10, ni=50, ties=False)
    hits = K.search(qu, it, 3, methods=("sim", "mmr"))
    counts = {r.method: r["count"] for r in hits.groupBy("method").count().collect()}
    assert counts == {"sim": 10 * 2 * 3, "mmr": 10 * 2 * 3}
    sim = _got(hits.where("method = 'sim'"))
    assert sim == _brute(Q, X, 3, True)


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_sparse_vectors_equal_dense(spark, block_rows):
    Q, X, qu, it = _frames(spark, seed=9, ties=False)
    Q = np.where(np.abs(Q) > 0.8, Q, 0.0)
    X = np.where(np.abs(X) > 0.8, X, 0.0)

    def sp(v):
        nz = np.nonzero(v)[0]
        return [int(i) for i in nz], [float(v[i]) for i in nz]
    items = [("m", i, f"p{i // 2:03d}", "ALL" if i % 2 == 0 else "LAST", *sp(X[i])) for i in range(len(X))]
    queries = [("m", f"q{j}", *sp(Q[j])) for j in range(len(Q))]
    it_s = spark.createDataFrame(items, "model string, doc_ord long, path string, cat_type string, "
                                        "idx array<int>, val array<double>")
    qu_s = spark.createDataFrame(queries, "model string, uid string, idx array<int>, val array<double>")
    got = _got(K.search(qu_s, it_s, 4, methods=("sim", "mmr"), fetch_k=8, sparse_dim=X.shape[1],
                        block_rows=block_rows).where("method = 'sim'"))
    assert got == _brute(Q, X, 4, True)
    mm = K.search(qu_s, it_s, 4, methods=("mmr",), fetch_k=8, sparse_dim=X.shape[1], block_rows=block_rows)
    it_d = spark.createDataFrame([("m", i, f"p{i // 2:03d}", "ALL" if i % 2 == 0 else "LAST", X[i].tolist())
                                  for i in range(len(X))],
                                 "model string, doc_ord long, path string, cat_type string, vec array<double>")
    qu_d = spark.createDataFrame([("m", f"q{j}", Q[j].tolist()) for j in range(len(Q))],
                                 "model string, uid string, vec array<double>")
    md = K.search(qu_d, it_d, 4, methods=("mmr",), fetch_k=8)
    key = lambda r: (r.uid, r.cat_type, r.rank, r.doc_ord, r.mmr_step)
    assert sorted(map(key, mm.collect())) == sorted(map(key, md.collect()))


def test_per_model_broadcast_equals_single_plan(spark):
    Q, X, qu, it = _frames(spark, seed=12, ties=False)
    qu2 = qu.unionByName(qu.withColumn("model", F.lit("n")))
    it2 = it.unionByName(it.withColumn("model", F.lit("n")).withColumn(
        "vec", F.transform("vec", lambda x: x * 2.0)))
    plan = K.block_plan(it2, 4096)
    one = max(plan["item_bytes_by_model"].values())
    assert plan["item_bytes"] > one
    key = lambda r: (r.model, r.uid, r.cat_type, r.rank, r.doc_ord)
    a = sorted(map(key, K.knn(qu2, it2, 3, broadcast_bytes=one).collect()))      # per model
    b = sorted(map(key, K.knn(qu2, it2, 3).collect()))                            # one broadcast
    c = sorted(map(key, K.knn(qu2, it2, 3, block_rows=5, broadcast_bytes=0).collect()))  # waves of a block
    assert a == b == c


def test_column_vector_functions(spark):
    from taxomatch.functions import vectors as VF
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [0.0, 2.0, 1.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0])],
                               "a array<double>, b array<double>")
    r = df.select(VF.sq_l2("a", "b").alias("d"), VF.cosine("a", "b").alias("c"), VF.dot("a", "b").alias("p"),
                  VF.sq_norm("a").alias("n")).collect()
    assert r[0].d == 2.0 and r[0].p == 6.0 and r[0].n == 9.0
    assert math.isclose(r[0].c, 6.0 / (3.0 * math.sqrt(5.0)))
    assert r[1].c is None and r[1].d == 1.0


def test_tiny_chunks_same_result(spark, monkeypatch):
    Q, X, qu, it = _frames(spark, seed=21, nq=30, ni=40, ties=True)
    monkeypatch.setattr(K, "_CHUNK_BYTES", 64)          # forces many small chunks
    rows = K.search(qu, it, 4, methods=("sim", "mmr"), fetch_k=8).collect()
    monkeypatch.undo()
    sim = {}
    for r in rows:
        if r.method == "sim":
            sim.setdefault((r.uid, r.cat_type), []).append((r.rank, r.doc_ord))
    assert {key: [o for _, o in sorted(v)] for key, v in sim.items()} == _brute(Q, X, 4, True)
    ref = K.search(qu, it, 4, methods=("mmr",), fetch_k=8).collect()
    key = lambda r: (r.uid, r.cat_type, r.rank, r.doc_ord, r.mmr_step)
    assert sorted(key(r) for r in rows if r.method == "mmr") == sorted(map(key, ref))


@pytest.mark.parametrize("form", [dict(), dict(block_rows=4), dict(block_rows=4, broadcast_bytes=0)])
def test_nulls_are_the_same_in_every_form(spark, form):
    """No vector: no hit.  A null path or type is an ordinary value.  Null models and keys take no part."""
    qs = [("m", f"q{i}", None if i == 0 else [float(i), 0.0]) for i in range(6)] + [(None, "x", [1.0, 0.0]), ("m", None, [1.0, 1.0])]
    its = [("m", i, None if i % 4 == 1 else f"p{i}", None if i % 5 == 2 else "ALL",
            None if i % 3 == 2 else [float(i), 1.0]) for i in range(20)] + [(None, 50, "p", "ALL", [0.0, 0.0])]
    q = spark.createDataFrame(qs, "model string, uid string, vec array<double>")
    it = spark.createDataFrame(its, "model string, doc_ord long, path string, cat_type string, vec array<double>")
    for by_type in (False, True):
        rows = K.search(q, it, 3, methods=("sim", "mmr"), fetch_k=4, by_type=by_type, **form).collect()
        got = {}
        for r in rows:
            if r.method == "sim":
                got.setdefault((r.uid, r.cat_type), []).append((r.rank, r.doc_ord, r.path, r.distance))
        want = {}
        for _, uid, v in qs[1:6]:
            for t in ({x[3] for x in its} if by_type else {"ANY"}):
                hits = sorted((sum((a - b) ** 2 for a, b in zip(v, x[4])), x[1], x[2]) for x in its
                              if x[0] and x[4] and (not by_type or x[3] == t))[:3]
                want[uid, t] = [(i + 1, o, p, d) for i, (d, o, p) in enumerate(hits)]
        assert {k: sorted(v) for k, v in got.items()} == want
        assert {r.uid for r in rows if r.method == "mmr"} == {f"q{i}" for i in range(1, 6)}


def test_small_bounds_do_not_grow_the_plan(spark):
    """Blocks of an item and a bound of a byte: some waves, and one pack of items in each."""
    Q, X, qu, it = _frames(spark)
    hits = K.knn(qu, it, 5, block_rows=1, broadcast_bytes=1)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert 1 < plan.count("BroadcastHashJoin") <= K.MAX_WAVES
    assert _got(hits) == _brute(Q, X, 5, True)
    packs = K.knn(qu, it, 5, block_rows=1)
    number = re.findall(r"pmod\(xxhash64\(doc_ord#\w+, 42\), cast\((\d+) as bigint\)\)",
                        packs._jdf.queryExecution().analyzed().toString())
    assert set(number) == {"1"}
    assert _got(packs) == _brute(Q, X, 5, True)
