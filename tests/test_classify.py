"""End-to-end jobs: files -> collections -> answers; ad-hoc texts; word vectors."""

import os

from pyspark.sql import functions as F

from taxomatch.functions.vectors import vector_shape
from taxomatch.plans import classify as C


def _embed(df):
    # a tiny deterministic stand-in model: letter counts of four letters
    t = F.lower(F.coalesce("text", F.lit("")))
    return df.withColumn("vec", F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double")
                                          for c in "aeio"]))


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


def test_classify_files(spark, scratch):
    _write(f"{scratch}/in/categories.csv", "cleanHandle\nkitchen/pots--pans\noffice/desk-lamps\ngarden/hose\n")
    _write(f"{scratch}/in/products.csv",
           "uniqueIdentifier;metaTitle;metaDescription;metaSpecs;vendorCategory;vendor\r"
           "p1;Steel pan, 28 cm;;;['Pans'];A\rp2;Desk lamp;;;Lamps;B\rp3;Garden hose;;;;C\r")
    models = {"m1:v1": _embed, "m2/x": _embed}
    for approach in ("direct", "vote", "ensemble"):
        ans = C.classify_files(spark, f"{scratch}/in/categories.csv", f"{scratch}/in/products.csv",
                               f"{scratch}/store", models, f"{scratch}/out-{approach}", approach=approach)
        got = {r._id: r.category for r in ans.collect()}
        assert set(got) == {"p1", "p2", "p3"}
        assert set(got.values()) <= {"kitchen/pots--pans", "office/desk-lamps", "garden/hose"}
    # the collections were filled once: a second run adds nothing
    from taxomatch.sources.collections import VectorStore
    counts = {(r.side, r.model): r.n for r in VectorStore(spark, f"{scratch}/store").counts().collect()}
    assert counts == {("categories", "m1_v1"): 6, ("categories", "m2-x"): 6,
                      ("products", "m1_v1"): 3, ("products", "m2-x"): 3}


def test_search_texts(spark):
    items = spark.createDataFrame([(0, "a", "ALL", [1.0, 0.0, 0.0, 0.0]), (1, "b", "ALL", [0.0, 1.0, 0.0, 0.0])],
                                  "doc_ord long, path string, cat_type string, vec array<double>")
    texts = spark.createDataFrame([("t1", "aaa"), ("t2", "eee")], "uid string, text string")
    hits = C.search_texts(texts, _embed, items, k=1, methods=("sim",))
    assert {r.uid: r.path for r in hits.collect()} == {"t1": "a", "t2": "b"}


def test_classify_with_word_vectors(spark):
    cats = spark.createDataFrame([(0, "kitchen/pans"), (1, "office/lamps")], "cat_idx long, path string")
    prods = spark.createDataFrame([("p1", "Red pan", "kitchen"), ("p2", "Lamp", None)],
                                  "uid string, title string, vendor_category string")
    wv = spark.createDataFrame([("kitchen", [1.0, 0.0]), ("pans", [1.0, 0.1]), ("pan", [1.0, 0.0]),
                                ("office", [0.0, 1.0]), ("lamps", [0.1, 1.0]), ("lamp", [0.0, 1.0])],
                               "word string, vec array<double>")
    got = {r._id: r.category for r in C.classify_with_word_vectors(prods, cats, wv, 2).collect()}
    assert got == {"p1": "kitchen/pans", "p2": "office/lamps"}
    assert vector_shape(wv).first().asDict() == {"n": 6, "min_dim": 2, "max_dim": 2}


def test_classify_files_edited_categories(spark, scratch):
    prod = ("uniqueIdentifier;metaTitle;metaDescription;metaSpecs;vendorCategory;vendor\r"
            "p1;Steel pan;;;;A\r")
    _write(f"{scratch}/in/products.csv", prod)
    _write(f"{scratch}/in/c1.csv", "cleanHandle\nkitchen/pans\n")
    _write(f"{scratch}/in/c2.csv", "cleanHandle\noffice/lamps\n")      # same position, other path
    models = {"m": _embed}
    a = C.classify_files(spark, f"{scratch}/in/c1.csv", f"{scratch}/in/products.csv", f"{scratch}/store",
                         models, f"{scratch}/o1", approach="direct")
    b = C.classify_files(spark, f"{scratch}/in/c2.csv", f"{scratch}/in/products.csv", f"{scratch}/store",
                         models, f"{scratch}/o2", approach="direct")
    assert [r.category for r in a.collect()] == ["kitchen/pans"]
    assert [r.category for r in b.collect()] == ["office/lamps"]
