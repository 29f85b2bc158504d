"""TF-IDF: terms joined in both forms, sparse scores on the non-zero terms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxomatch.operators import embed as EM
from taxomatch.operators import knn as K


def test_term_joins_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"t{j}", float(j)) for i in range(30) for j in range(i % 9 + 1)],
                                 "key long, term string, w double")
    terms = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idx", F.length("term"))
    monkeypatch.setattr(EM, "HOT_SHARE", 5)
    key = lambda r: (r.key, r.term)
    small = sorted(map(tuple, EM.join_terms(rows, terms).collect()))
    large = EM.join_terms(rows, terms, limit=0)
    assert sorted(map(tuple, large.collect())) == small and len(small) == rows.count()
    assert large.columns == ["term", "key", "w", "idx"] and key


@pytest.mark.parametrize("metric", ["dot", "l2", "cosine"])
def test_sparse_scores_equal_dense(spark, metric):
    r = np.random.default_rng(3)
    dense = r.integers(0, 3, (60, 12)).astype(float) * (r.random((60, 12)) < 0.3)
    rows = [(i, [int(j) for j in np.nonzero(v)[0]], [float(x) for x in v[v != 0]], v.tolist())
            for i, v in enumerate(dense)]
    df = spark.createDataFrame(rows, "i long, idx array<int>, val array<double>, vec array<double>")
    q = df.where("i < 20").withColumn("uid", F.col("i").cast("string"))
    it = df.where("i >= 20").withColumns({"doc_ord": F.col("i"), "path": F.concat(F.lit("p"), "i"),
                                          "cat_type": F.when(F.col("i") % 2 == 0, "ALL").otherwise("LAST")})
    key = lambda h: sorted((x.uid, x.cat_type, x.rank, x.doc_ord, None if x.distance != x.distance else x.distance)
                           for x in h.collect())
    want = key(K.knn(q.select("uid", "vec"), it.select("doc_ord", "path", "cat_type", "vec"), 4, metric=metric,
                     round_digits=9))
    for rows_ in (2048, 7):
        got = key(K.knn(q.select("uid", "idx", "val"), it.select("doc_ord", "path", "cat_type", "idx", "val"), 4,
                        metric=metric, round_digits=9, sparse_dim=12, block_rows=rows_))
        assert str(got) == str(want)


def test_a_model_is_loaded_once_per_worker_and_equal_texts_embedded_once(spark, tmp_path, monkeypatch):
    log = str(tmp_path)

    def load():
        import os
        import uuid
        open(f"{log}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            with open(f"{log}/texts-{uuid.uuid4().hex}", "w") as f:
                f.write("".join(t + "\n" for t in texts))
            return [[len(t), 1] for t in texts]
        return model

    rows = [(i, "hot" if i % 3 else f"text {i % 40}", i) for i in range(600)] + [(600, None, 0), (601, "", 1)]
    docs = spark.createDataFrame(rows, "id long, text string, df long").repartition(16)
    monkeypatch.setattr(EM, "BROADCAST_VECTORS", 5)         # the join by shuffle, hot texts by broadcast
    embed = EM.loaded_model(load)
    for _ in range(2):
        out = embed(docs)
        assert out.columns == ["id", "text", "df", "vec"]
        assert sorted(tuple(r) for r in out.select("id", "df", "vec").collect()) == \
            [(i, n, [float(len(t or "")), 1.0]) for i, t, n in rows]
    loads = [f.name.split("-")[1] for f in tmp_path.iterdir() if f.name.startswith("load-")]
    assert loads and len(loads) == len(set(loads))          # no worker loaded twice
    seen = [t for f in tmp_path.iterdir() if f.name.startswith("texts-") for t in f.read_text().split("\n")[:-1]]
    assert len(seen) == 2 * len({t or "" for _, t, _ in rows})
