"""Corpus, vocabulary, overlay, mean word vectors, Word2Vec."""

import numpy as np
from pyspark.sql import functions as F

from taxomatch.operators import words as W


def test_vocabulary_min_count(spark):
    corpus = spark.createDataFrame([("1", ["red", "pan", "red"]), ("2", ["pan", "lid"])],
                                   "sent_id string, tokens array<string>")
    assert {r.word: r["count"] for r in W.vocabulary(corpus).collect()} == {"red": 2, "pan": 2}
    size = W.corpus_size(corpus).first()
    assert (size.n_sentences, size.n_tokens) == (2, 5)


def test_mean_vectors_and_zero_case(spark):
    docs = spark.createDataFrame([("a", "Red pan, red!"), ("b", "nothing known"), ("c", None)],
                                 "k string, t string")
    wv = spark.createDataFrame([("red", [1.0, 0.0]), ("pan", [0.0, 4.0])], "word string, vec array<double>")
    got = {r.k: (r.vec, r.known_words) for r in W.mean_vectors(docs, "k", F.col("t"), wv, 2).collect()}
    assert np.allclose(got["a"][0], [2 / 3, 4 / 3]) and got["a"][1] == 3
    assert got["b"] == ([0.0, 0.0], 0)
    assert got["c"] == ([0.0, 0.0], 0)
    kw = {r.k: r.words for r in W.known_words(docs, "k", F.col("t"), wv, as_list=True).collect()}
    assert kw == {"a": ["red", "pan", "red"]}
    rows = sorted((r.k, r.pos, r.word) for r in W.known_words(docs, "k", F.col("t"), wv).collect())
    assert rows == [("a", 0, "red"), ("a", 1, "pan"), ("a", 2, "red")]


def test_overlay(spark):
    vocab = spark.createDataFrame([("red", 3), ("pan", 2)], "word string, count long")
    trained = spark.createDataFrame([("red", [9.0]), ("pan", [8.0])], "word string, vec array<double>")
    pre = spark.createDataFrame([("red", [1.0]), ("lid", [2.0])], "word string, vec array<double>")
    got = {r.word: (r.vec, r.pretrained) for r in W.overlay(vocab, trained, pre).collect()}
    assert got == {"red": ([1.0], True), "pan": ([8.0], False)}
    full = {r.word for r in W.overlay(vocab, trained, pre, keep_pretrained=True).collect()}
    assert full == {"red", "pan", "lid"}


def test_corpus_and_word2vec(spark):
    cats = spark.createDataFrame([(0, "kitchen/pots--pans"), (1, "office/desk-lamps")], "cat_idx long, path string")
    prods = spark.createDataFrame([("1", "Steel pan", "kitchen pan", "['Pans']"),
                                   ("2", "Desk lamp", "office lamp", None)],
                                  "uid string, title string, description string, vendor_category string")
    corpus = W.build_corpus(cats, prods)
    toks = {r.sent_id: r.tokens for r in corpus.collect()}
    assert toks["c:0#0"] == ["kitchen", "pots", "pans"]
    assert toks["p:2#0"] == ["desk", "lamp", "office", "lamp", "nan"]
    wv = W.train_word2vec(corpus, vector_size=4, epochs=1, min_count=1)
    assert wv.count() == len({w for t in toks.values() for w in t})
    assert all(len(r.vec) == 4 for r in wv.collect())


def test_hot_words_are_dealt_out(spark):
    rare = [(f"k{i}", f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}") for i in range(4000)]
    rows = rare + [(f"k{i}", " ".join(["steel"] * 3 + ["pan"])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "k string, t string")
    words = sorted({w for _, t in rows for w in t.split()})
    wv = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate(words) if i % 7], "word string, vec array<double>")
    toks = W._positions(docs, "k", F.col("t"), False)
    assert sorted(W.hot_words(toks)) == ["pan", "steel"]
    assert W.hot_words(toks.limit(0)) == []
    for limit in (0, None):
        assert ("_part" in W.join_words(toks, wv, limit=limit)._jdf.queryExecution().toString()) == (limit == 0)
    read = lambda df: sorted(map(tuple, df.collect()), key=str)
    same = lambda f: read(f(0)) == read(f(None))
    mean = lambda n: W.mean_vectors(docs, "k", F.col("t"), wv, 2, broadcast_bytes=n).withColumn(
        "vec", F.transform("vec", lambda x: F.round(x, 6)))
    assert same(mean)
    assert same(lambda n: W.known_words(docs, "k", F.col("t"), wv, broadcast_bytes=n))


def test_vectors_do_not_travel_per_token(spark):
    """Sums of flat rows when the table is broadcast; else word numbers are joined, and the vectors
    go to slices of the texts.  Null and repeated keys and words without a text included."""
    docs = spark.createDataFrame([("a", "red pan red"), ("a", "lid"), (None, "red"), ("b", "none here"), ("c", None),
                                  ("d", "void"), ("e", "void pan")],
                                 "k string, t string")
    wv = spark.createDataFrame([("red", [1.0, 0.0]), ("pan", [0.0, 4.0]), ("lid", [3.0, 0.0]), ("x", [9.0, 9.0]), ("void", None)],
                               "word string, vec array<double>")
    for limit in (None, 0):
        mv = W.mean_vectors(docs, "k", F.col("t"), wv, 2, broadcast_bytes=limit)
        plan = mv._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in plan
        assert ("FlatMapCoGroupsInArrow" in plan) == (limit == 0)
        got = sorted(((r.k, r.vec, r.known_words) for r in mv.collect()), key=str)
        assert got == [("a", [1.25, 1.0], 4), ("a", [1.25, 1.0], 4), ("b", [0.0, 0.0], 0), ("c", [0.0, 0.0], 0),
                       ("d", [0.0, 0.0], 1), ("e", [0.0, 4.0], 2), (None, [0.0, 0.0], 0)]


def test_packed_words_of_slices_and_steps(spark, monkeypatch):
    """The dealt form with many slices, steps that cut a text, long and repeated texts and vectors
    that single precision does or does not hold: numpy's means."""
    import numpy as np

    rng = np.random.default_rng(3)
    letters = list("abcdefghij")
    words = ["z" + "".join(rng.choice(letters, 5)) for _ in range(300)]
    words = sorted(set(words))
    texts = [(f"k{i % 40}", " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(60)]
    texts.append(("long", " ".join(rng.choice(words, 25_000))))
    docs = spark.createDataFrame(texts, "k string, t string").repartition(3)
    monkeypatch.setattr(W, "SLICE_WORDS", 500)
    monkeypatch.setattr(W, "STEP_BYTES", 7 * 76)
    for single in (True, False):
        table = {w: np.float32(rng.normal(size=3)).astype(float) if single else rng.normal(size=3)
                 for i, w in enumerate(words) if i % 5}
        wv = spark.createDataFrame([(w, v.tolist()) for w, v in table.items()], "word string, vec array<double>")
        want = {}
        for k, t in texts:
            want.setdefault(k, []).extend(table[w] for w in t.split() if w in table)
        known = W._positions(docs, "k", F.col("t"), False)
        for limit in (0, 64 * len(table)):                    # numbers by shuffle, and broadcast
            mv = W.mean_vectors(docs, "k", F.col("t"), wv, 3, broadcast_bytes=limit)
            assert "FlatMapCoGroupsInArrow" in mv._jdf.queryExecution().executedPlan().toString()
            got = {r.k: (r.vec, r.known_words) for r in mv.collect()}
            assert got.keys() == want.keys()
            for k, vs in want.items():
                assert got[k][1] == len(vs)
                assert np.allclose(got[k][0], np.mean(vs, axis=0) if vs else np.zeros(3))
        assert known.count() > 25_000


def test_numbers_of_words_are_broadcast(spark, monkeypatch):
    """A table of vectors over the limit whose words are under it: tokens are not shuffled by word."""
    docs = spark.createDataFrame([("a", "red pan red")], "k string, t string")
    wv = spark.createDataFrame([(w, [1.0] * 64) for w in ("red", "pan", "lid")], "word string, vec array<double>")
    seen = []
    join = W.join_words
    monkeypatch.setattr(W, "join_words", lambda *a, **b: seen.append(join(*a, **b)) or seen[-1])
    mv = W.mean_vectors(docs, "k", F.col("t"), wv, 64, broadcast_bytes=400)
    assert [(r.vec[0], r.known_words) for r in mv.collect()] == [(1.0, 3)]
    assert "BroadcastHashJoin" in seen[0]._jdf.queryExecution().executedPlan().toString()
