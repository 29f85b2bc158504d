"""Quality classifier and quality rules."""

import random
import zlib
from collections import defaultdict

import numpy as np
from llm_cases import ROWS, empty, odd
from pyspark.sql import functions as F

from taxomatch.llm import quality_model as M
from taxomatch.llm import quality_rules as R
from taxomatch.llm import queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = queries.op1_quality_model(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 50 and {r.quality for r in unseen} == {0, 1}
    assert sum(r.predicted == r.quality for r in unseen) / len(unseen) > 0.95


def test_labels_of_held_out_rows_do_not_count(spark):
    stats = M.with_statistics(odd(spark).select("doc_id", "text"))
    ids = [r.doc_id for r in stats.where(M.held_out(F.col("doc_id"))).collect()]
    labels = spark.createDataFrame([(i, 1) for i in range(1, 15)], "doc_id long, quality int")
    got = M.training_rows(stats, labels).count()
    assert ids and got == sum(1 for i, _ in ROWS if i is not None and i not in ids)


def test_sums_give_the_class_densities(spark):
    r = np.random.default_rng(1)
    d = len(M.FEATURES)
    x = r.normal(size=(400, d)) * np.arange(1, d + 1)
    y = np.arange(400) % 2
    x[y == 1] += 2
    rows = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y)], "statistics array<double>, label int")
    m = M.fit(rows.repartition(5), 0.0, 1e-9, 1.0, 0.0)
    own = []
    for c in (0, 1):
        part = x[y == c]
        diff, cov = x - part.mean(axis=0), np.cov(part.T, bias=True)
        own.append(-0.5 * (diff @ np.linalg.inv(cov) * diff).sum(axis=1) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(-np.clip(own[1] - own[0], -700, 700)))
    assert np.allclose(m.scores(x), want, atol=1e-4)


def test_short_texts_are_not_condemned(spark):
    rows = queries.op1_quality_model(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").join(
        spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    short = [r for r in rows if 0 < len(r.text.split()) < 10 and r.quality == 1]
    assert all(r.predicted == 1 for r in short)


def test_model_without_two_classes(spark):
    none = M.fit(M.with_statistics(empty(spark)).select("statistics", F.lit(1).alias("label")))
    assert none.scores(np.zeros((2, len(M.FEATURES)))).tolist() == [0.5, 0.5]
    one = M.fit(M.with_statistics(odd(spark)).select("statistics", F.lit(1).alias("label")))
    assert one.scores(np.zeros((1, len(M.FEATURES))))[0] > 0.9


def test_filter_keeps_columns_and_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("statistics", F.lit("mine"))
    kept = M.keep_good(docs, labels)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in queries.op1_quality_model(spark, SF).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good
    assert M.keep_good(empty(spark), labels).count() == 0
    assert M.keep_good(odd(spark), labels.limit(0)).count() == len(ROWS)  # no labels: 0.5 each


def _brute(text):
    w = [x.decode() for x in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(hit))


def test_rules_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice(["a", "b", "a b", " ", "\n", "#", "é", "\t", "\u2003", "\x1c", "A!"])
                        for _ in range(r.randrange(80)))) for i in range(400)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(ROWS)]
    got = R.quality_rules(odd(spark, rows)).collect()
    want = dict(rows)
    assert len(got) == len(rows)
    for x in got:
        b = _brute(want[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == b, repr(want[x.doc_id])
        assert x.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
        assert not (x.kept and x.base_failed)
    assert R.quality_rules(empty(spark)).count() == 0


def test_rules_are_one_projection(spark):
    plan = R.quality_rules(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
