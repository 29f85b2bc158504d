"""The query catalogue: one callable ``(spark, sf_dir) -> DataFrame`` per

Every query reads whole tables; distances are rounded to 6 digits, ranks,
counts and votes are integers, so that the DuckDB oracle in ``plans.oracle``
can be compared value by value.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxomatch.functions import text as TX
from taxomatch.functions import vectors as VF
from taxomatch.operators import docs as D
from taxomatch.operators import embed as EM
from taxomatch.operators import knn as K
from taxomatch.operators import rows as R
from taxomatch.operators import skipgram as SG
from taxomatch.operators import vote as V
from taxomatch.operators import words as W
from taxomatch.plans import classify as C
from taxomatch.plans import fixtures as X
from taxomatch.session import materialize, scratch_path
from taxomatch.sources import answers as A
from taxomatch.sources import collections as S
from taxomatch.sources import csv as CSV
from taxomatch.sources import wordvec as WV
from taxomatch.sources.textindex import TextIndex
from taxomatch.streaming import incremental as ST
from taxomatch.streaming import newest as SN

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _hits_out(h: DataFrame, *extra: str) -> DataFrame:
    return h.select("uid", *extra, F.col("rank").cast("long").alias("rank"), "doc_ord", "path",
                    F.round("distance", 6).alias("distance"))


# --------------------------------------------------------------------------- k-NN

@query
def knn_top1(spark: SparkSession, d: str) -> DataFrame:
    h = K.nearest(X.vec_queries(spark, d), X.vec_items(spark, d))
    return h.select("uid", "doc_ord", "path", F.round("distance", 6).alias("distance"))


@query
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    h = K.knn(X.vec_queries(spark, d), X.vec_items(spark, d), 10, by_type=False)
    return _hits_out(h)


@query
def knn_topk_by_type(spark: SparkSession, d: str) -> DataFrame:
    h = K.knn(X.vec_queries(spark, d), X.vec_items(spark, d), 10, by_type=True)
    return _hits_out(h, "cat_type")


@query
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    m = ("m1",)
    h = K.knn(X.vec_queries(spark, d, m), X.vec_items(spark, d, m), 5, by_type=True, metric="cosine")
    return _hits_out(h, "cat_type")


@query
def knn_ensemble_lists(spark: SparkSession, d: str) -> DataFrame:
    """U-B: the similarity lists of all models in one pass (model is a key)."""
    m = X.ENSEMBLE_MODELS
    h = K.knn(X.vec_queries(spark, d, m), X.vec_items(spark, d, m), 5, by_type=True)
    return _hits_out(h, "model", "cat_type")


# --------------------------------------------------------------------------- MMR (L3)

def _mmr(spark, d, model, k):
    m = (model,)
    h = K.search(X.vec_queries(spark, d, m), X.vec_items(spark, d, m), k, methods=("mmr",),
                 by_type=True)
    return h.select("uid", "model", "cat_type", F.col("rank").cast("long").alias("rank"),
                    F.col("mmr_step").cast("long").alias("mmr_step"), "doc_ord", "path",
                    F.round("distance", 6).alias("distance"))


@query
def mmr_top3(spark: SparkSession, d: str) -> DataFrame:
    return _mmr(spark, d, "m1", 3)


@query
def mmr_top10(spark: SparkSession, d: str) -> DataFrame:
    return _mmr(spark, d, "principal", 10)


# --------------------------------------------------------------------------- votes (W1 W2 A1-A4 U-A)

def _voted(spark, d, models=("principal",), k=10, methods=("sim", "mmr")):
    return C.vote_hits(X.vec_queries(spark, d, models), X.vec_items(spark, d, models), k,
                       methods=methods)


@query
def rank_votes(spark: SparkSession, d: str) -> DataFrame:
    v = _voted(spark, d, methods=("sim",))
    return v.select("uid", "cat_type", F.col("rank").cast("long").alias("rank"), "path", "centivotes")


@query
def vote_box(spark: SparkSession, d: str) -> DataFrame:
    return V.vote_box(_voted(spark, d))


@query
def vote_winner(spark: SparkSession, d: str) -> DataFrame:
    return V.vote_winner(V.vote_box(_voted(spark, d)))


@query
def vote_map(spark: SparkSession, d: str) -> DataFrame:
    """A4 as text: ``path=centivotes`` pairs in path order."""
    m = V.vote_map(V.vote_box(_voted(spark, d)))
    return m.select("uid", F.array_join(F.transform(F.map_entries("box"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("box"))


# --------------------------------------------------------------------------- classification

@query
def classify_direct(spark: SparkSession, d: str) -> DataFrame:
    return C.classify_direct(X.vec_queries(spark, d), X.vec_items(spark, d))


@query
def classify_vote(spark: SparkSession, d: str) -> DataFrame:
    return C.classify_vote(X.vec_queries(spark, d), X.vec_items(spark, d), k=10)


@query
def classify_vote_sim(spark: SparkSession, d: str) -> DataFrame:
    return C.classify_vote(X.vec_queries(spark, d), X.vec_items(spark, d), k=10, methods=("sim",))


@query
def classify_ensemble(spark: SparkSession, d: str) -> DataFrame:
    m = X.ENSEMBLE_MODELS
    return C.classify_ensemble(X.vec_queries(spark, d, m), X.vec_items(spark, d, m), k=5)


@query
def classify_slices(spark: SparkSession, d: str) -> DataFrame:
    m = X.ENSEMBLE_MODELS
    return C.classify_in_slices(X.vec_queries(spark, d, m), X.vec_items(spark, d, m), 4, k=5)


@query
def search_report(spark: SparkSession, d: str) -> DataFrame:
    h = C.search_report(X.vec_queries(spark, d), X.vec_items(spark, d), k=5)
    return h.select("uid", "method", "cat_type", F.col("rank").cast("long").alias("rank"),
                    F.col("mmr_step").cast("long").alias("mmr_step"), "doc_ord", "path",
                    F.round("distance", 6).alias("distance"))


# --------------------------------------------------------------------------- text and documents


@query
def category_text(spark: SparkSession, d: str) -> DataFrame:
    return X.cat(spark, d).select("cat_idx", "path", TX.path_text("path").alias("text"))


@query
def category_docs(spark: SparkSession, d: str) -> DataFrame:
    return D.category_documents(X.cat(spark, d)).select(
        "id", "cat_idx", "path", F.col("level").cast("long").alias("level"), "cat_type", "text", "doc_ord")


@query
def category_levels(spark: SparkSession, d: str) -> DataFrame:
    c = X.cat(spark, d)
    return c.select("cat_idx", TX.path_level("path").cast("long").alias("level"),
                    F.element_at(TX.path_parts("path"), 1).alias("root"),
                    TX.path_leaf("path").alias("leaf"))


@query
def doc_ids_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = R.with_row_index(X.table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], "idx")
    out = D.run_counter(docs, "lang", "idx", "n")
    return out.select("doc_id", "lang", "n", F.concat_ws(":", "lang", F.col("n").cast("string")).alias("id"))


@query
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """G4 over the category documents in document order (ALL, LAST per category)."""
    docs = D.category_documents(X.cat(spark, d)).select("cat_idx", "level", "cat_type", "doc_ord")
    docs = docs.withColumnRenamed("doc_ord", "idx")
    out = D.chunk_ids(docs, D.CATEGORY_SOURCE, "cat_idx", "level", "idx")
    return out.select("idx", "cat_type", "id")


@query
def type_extract(spark: SparkSession, d: str) -> DataFrame:
    c = X.cat(spark, d).select("cat_idx", TX.path_text("path", TX.TYPE_DOUBLE_DASH_TEXT).alias("text"))
    return c.select("cat_idx", "text", TX.extract_all("text").alias("types_all"),
                    TX.extract_first("text").alias("type_first"),
                    TX.extract_first("text", " for (.*?) type: ").alias("for_first"))


@query
def vendor_labels(spark: SparkSession, d: str) -> DataFrame:
    p = X.prod(spark, d).select("uid", "vendor_category", TX.vendor_labels("vendor_category").alias("l"))
    return p.select("uid", "vendor_category", F.size("l").cast("long").alias("n_labels"),
                    F.array_join("l", "|", "<null>").alias("labels"))


@query
def product_text(spark: SparkSession, d: str) -> DataFrame:
    p = X.prod(spark, d)
    return p.select("uid", TX.title_head("title").alias("head"),
                    TX.product_text("title", "vendor_category").alias("text"))


@query
def product_text_plain(spark: SparkSession, d: str) -> DataFrame:
    p = X.prod(spark, d)
    return p.select("uid", TX.product_text("title", "vendor_category", joiner=" ").alias("text"))


@query
def product_text_words(spark: SparkSession, d: str) -> DataFrame:
    p = X.prod(spark, d)
    return p.select("uid", TX.product_word_text("title", "vendor_category").alias("text"))


@query
def corpus_text(spark: SparkSession, d: str) -> DataFrame:
    p = X.prod(spark, d)
    return p.select("uid", TX.corpus_text("title", "description", "vendor_category").alias("text"))


@query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    docs = R.spread(X.table(spark, d, "documents"))
    c = docs.select("doc_id", TX.clean_text("text").alias("clean"))
    return c.where(TX.not_empty("clean"))


@query
def clean_category_text(spark: SparkSession, d: str) -> DataFrame:
    return X.cat(spark, d).select("cat_idx", TX.clean_text("path", cat=True).alias("clean"))


@query
def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    docs = R.spread(X.table(spark, d, "documents")).select(
        "doc_id", TX.clean_words("text").alias("w"))
    ch = TX.explode_tokens(docs, TX.chunk_words(F.col("w")), "c", "chunk_no", "doc_id")
    return ch.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"),
                     F.size("c").cast("long").alias("n_words"), F.array_join("c", " ").alias("chunk"))


@query
def tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = R.spread(X.table(spark, d, "documents")).select(
        "doc_id", TX.clean_words("text").alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_tokens"),
                       F.try_element_at("w", F.lit(1)).alias("first_token"),
                       F.try_element_at("w", F.lit(-1)).alias("last_token"))


def _doc_positions(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", "n_chars")
    return R.with_row_index(docs, ["doc_id"], "idx")


@query
def batch_report(spark: SparkSession, d: str) -> DataFrame:
    return R.batch_report(_doc_positions(spark, d), "idx", 128)


@query
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return R.every_nth(_doc_positions(spark, d), 20).select("idx", "doc_id")


@query
def slice_rows(spark: SparkSession, d: str) -> DataFrame:
    return R.position_slice(_doc_positions(spark, d), 3, 11).select("idx", "doc_id")


def _store_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a store id that is a key of their text: rows of one doc_id (or none)
    with other texts are documents of their own, only true repeats are stored once."""
    docs = X.table(spark, d, "documents")
    return docs.withColumn("id", S.text_id("doc_id", "text"))


@query
def contains_docs(spark: SparkSession, d: str) -> DataFrame:
    """A text search in a stored collection."""
    store = S.VectorStore(spark, scratch_path(spark, f"store-{uuid.uuid4().hex}"))
    docs = _store_docs(spark, d)
    store.add_missing(docs.select("id", "text"), S.PRODUCTS, {STORE_MODELS[0]: _hashing_embedder(4)})
    found = store.find_text(S.PRODUCTS, STORE_MODELS[0], "tion ").select("id")
    return docs.join(found, "id", "left_semi").select("doc_id", "n_chars")


@query
def contains_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The same search with the stored vectors."""
    store = S.VectorStore(spark, scratch_path(spark, f"store-{uuid.uuid4().hex}"))
    docs = _store_docs(spark, d)
    store.add_missing(docs.select("id", "text"), S.PRODUCTS, {"letters": _letters})
    found = store.find_text(S.PRODUCTS, "letters", "tion ", with_vectors=True).select("id", "vec")
    vec = F.transform("vec", lambda x: x.cast("long"))
    return docs.join(found, "id").select("doc_id", *[vec[i].alias(f"n_{c}") for i, c in enumerate(LETTERS)])


@query
def contains_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The search through the index of character runs: one part of the documents is
    indexed, the other is stored later and read without an index."""
    store = S.VectorStore(spark, scratch_path(spark, f"store-{uuid.uuid4().hex}"))
    docs = _store_docs(spark, d)
    index = TextIndex(store, S.PRODUCTS, "letters")
    store.add_missing(docs.where("n_chars % 3 > 0").select("id", "text"), S.PRODUCTS, {"letters": _letters})
    index.update()
    store.add_missing(docs.select("id", "text"), S.PRODUCTS, {"letters": _letters})
    found = index.find("tion ", with_vectors=True).select("id", "vec")
    vec = F.transform("vec", lambda x: x.cast("long"))
    return docs.join(found, "id").select("doc_id", *[vec[i].alias(f"n_{c}") for i, c in enumerate(LETTERS)])


# --------------------------------------------------------------------------- collections


# Model names of the store round trip (collection names are derived from them).
STORE_MODELS = ("nomic-embed-text:latest", "mxbai/embed-large:v1")


def _hashing_embedder(dim: int):
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    def embed(df: DataFrame) -> DataFrame:
        toks = df.withColumn("_w", TX.clean_words("text"))
        tf = HashingTF(numFeatures=dim, inputCol="_w", outputCol="_tf").transform(toks)
        return tf.withColumn("vec", vector_to_array("_tf")).drop("_w", "_tf")
    return embed


@query
def missing_docs(spark: SparkSession, d: str) -> DataFrame:
    store = S.VectorStore(spark, scratch_path(spark, f"store-{uuid.uuid4().hex}"))
    docs = _store_docs(spark, d).select("id", "doc_id", "lang", "text")
    labelled = docs.join(X.table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    store.add_missing(labelled.select("id", "text"), S.PRODUCTS, {STORE_MODELS[0]: _hashing_embedder(4)})
    new = store.missing(docs.select("id"), S.PRODUCTS, STORE_MODELS[0])
    return docs.join(new, "id", "left_semi").select("doc_id", "lang")


@query
def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    """K3/K4 twice (stored ids first, then all documents) then A5: the second
    run only adds the missing documents, so every collection ends with each
    document exactly once."""
    store = S.VectorStore(spark, scratch_path(spark, f"store-{uuid.uuid4().hex}"))
    docs = _store_docs(spark, d).select("id", "doc_id", "text")
    labelled = docs.join(X.table(spark, d, "labels"), "doc_id", "left_semi").drop("doc_id")
    docs = docs.drop("doc_id")
    models = {m: _hashing_embedder(16) for m in STORE_MODELS}
    store.add_missing(labelled, S.PRODUCTS, models)
    store.add_missing(docs, S.PRODUCTS, models)
    return store.counts()


@query
def store_batch(spark: SparkSession, d: str) -> DataFrame:
    """A small batch against a large store: which of its rows are new.  Every tenth document
    is changed in the batch, and the batch reads only the buckets of its own ids."""
    store = S.VectorStore(spark, scratch_path(spark, f"store-{uuid.uuid4().hex}"))
    docs = _store_docs(spark, d).select("id", "doc_id", "text")
    store.add_missing(docs.select("id", "text"), S.PRODUCTS, {STORE_MODELS[0]: _hashing_embedder(4)})
    batch = docs.where("doc_id % 50 = 0").withColumn(
        "text", F.when(F.col("doc_id") % 100 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    batch = batch.withColumn("id", S.text_id("doc_id", "text"))
    return store.missing(batch, S.PRODUCTS, STORE_MODELS[0]).select("doc_id")


@query
def collection_names(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "pages").select("page_id", S.collection_name("url").alias("name"))


# --------------------------------------------------------------------------- words

def _doc_corpus(spark, d):
    return W.sentences(X.table(spark, d, "documents"), "doc_id", F.col("text"))


@query
def vocab_counts(spark: SparkSession, d: str) -> DataFrame:
    return W.vocabulary(_doc_corpus(spark, d))


@query
def corpus_size(spark: SparkSession, d: str) -> DataFrame:
    return W.corpus_size(W.build_corpus(X.cat(spark, d), X.prod(spark, d)))


@query
def vocab_overlay(spark: SparkSession, d: str) -> DataFrame:
    vocab = W.vocabulary(W.build_corpus(X.cat(spark, d), X.prod(spark, d)), min_count=1)
    o = W.overlay(vocab, None, X.word_vecs(spark, d))
    return o.select("word", "count", "pretrained",
                    F.round(F.try_element_at("vec", F.lit(1)), 6).alias("v1"))


def _vec_summary(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, "known_words",
                     F.round(F.element_at("vec", 1), 6).alias("v1"),
                     F.round(F.element_at("vec", -1), 6).alias("vlast"),
                     F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("vsum"))


@query
def mean_word_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "documents")
    mv = W.mean_vectors(docs, "doc_id", F.col("text"), X.word_vecs(spark, d), 64)
    return _vec_summary(mv, "doc_id")


@query
def mean_word_vectors_dealt(spark: SparkSession, d: str) -> DataFrame:
    """The form for a table too large to broadcast: a shuffle join, hot words found by
    a frequent-items summary and dealt out."""
    docs = X.table(spark, d, "documents")
    mv = W.mean_vectors(docs, "doc_id", F.col("text"), X.word_vecs(spark, d), 64, broadcast_bytes=0)
    return _vec_summary(mv, "doc_id")


@query
def known_words(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "documents")
    kw = W.known_words(docs, "doc_id", F.col("text"), X.word_vecs(spark, d))
    return kw.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_known"),
                                    F.min_by("word", "pos").alias("first_known"),
                                    F.max_by("word", "pos").alias("last_known"))


@query
def word2vec_train(spark: SparkSession, d: str) -> DataFrame:
    """All epochs of the job; the vectors are random, the words and widths are not."""
    corpus = W.build_corpus(X.cat(spark, d), X.prod(spark, d))
    wv = W.train_word2vec(corpus, vector_size=32)
    return wv.select("word", F.size("vec").cast("long").alias("dim"))


def _start_vectors(spark, d) -> DataFrame:
    """Vectors to start from for the words of the corpus that have one."""
    return X.word_vecs(spark, d)


@query
def word2vec_start(spark: SparkSession, d: str) -> DataFrame:
    """Training from given vectors, no epoch: the start vectors; words without one get others."""
    vectors, _ = SG.train(_doc_corpus(spark, d), _start_vectors(spark, d), 64, epochs=0)
    return vectors.select("word", "count", "started", F.size("vec").cast("long").alias("dim"),
                          F.when(F.col("started"), F.round(F.element_at("vec", 1), 5)).alias("v1"),
                          F.when(F.col("started"), F.round(F.element_at("vec", -1), 5)).alias("vlast"))


@query
def word2vec_continue(spark: SparkSession, d: str) -> DataFrame:
    """Two epochs from given vectors on the product corpus: words, widths, and that
    every start vector has moved (the vectors themselves depend on drawn noise words)."""
    start = _start_vectors(spark, d)
    corpus = W.build_corpus(X.cat(spark, d), X.prod(spark, d))
    # Product words take the start vectors of the document vocabulary in order of their rank.
    ranked = R.with_row_index(W.vocabulary(corpus), ["word"], "rank").select("rank", F.col("word").alias("own"))
    given = R.with_row_index(start, ["word"], "rank").join(ranked, "rank").select(F.col("own").alias("word"), "vec")
    vectors, _ = SG.train(corpus, given, 64, epochs=2)
    moved = vectors.join(given.select("word", F.col("vec").alias("first")), "word", "left")
    return moved.select("word", "count", "started", F.size("vec").cast("long").alias("dim"),
                        F.when(F.col("started"), F.col("vec") != F.col("first")).alias("moved"))


@query
def word2vec_losses(spark: SparkSession, d: str) -> DataFrame:
    """The losses of three epochs: every pair of the corpus once in each, each loss under that before."""
    corpus = W.build_corpus(X.cat(spark, d), X.prod(spark, d))
    _, report = SG.train(corpus, None, 32, epochs=3)
    before = F.lag("loss").over(Window.orderBy("epoch"))  # one row per epoch
    return report.select(F.col("epoch").cast("long").alias("epoch"), "n_pairs",
                         F.coalesce(F.col("loss") < before, F.lit(True)).alias("lower"))


def _doc_vectors(spark, d):
    """Document vectors, written once (a stored collection): the search sizes
    its blocks from them and then reads them, without recomputing."""
    docs = X.table(spark, d, "documents")
    mv = W.mean_vectors(docs, "doc_id", F.col("text"), X.word_vecs(spark, d), 64)
    mv = mv.select(F.lit("principal").alias("model"), F.col("doc_id").cast("string").alias("uid"), "vec")
    return materialize(mv, "doc-vectors")


@query
def words_direct(spark: SparkSession, d: str) -> DataFrame:
    """Documents by mean word vector -> nearest category document."""
    return C.classify_direct(_doc_vectors(spark, d), X.vec_items(spark, d))


@query
def tfidf_direct(spark: SparkSession, d: str) -> DataFrame:
    """U1 + C1: TF-IDF of product texts (T7) and category documents, nearest by dot product."""
    cdocs = D.category_documents(X.cat(spark, d)).select(
        F.concat(F.lit("c:"), F.col("doc_ord").cast("string")).alias("id"), "text", "doc_ord", "path",
        "cat_type")
    p = X.prod(spark, d)
    pdocs = p.select(F.concat(F.lit("p:"), F.col("uid")).alias("id"),
                     TX.product_text("title", "vendor_category").alias("text"))
    alldocs = cdocs.select("id", "text").unionByName(pdocs)
    vecs, dim = EM.tfidf(alldocs, F.col("id").startswith("c:"))
    items = cdocs.join(vecs, "id").select("doc_ord", "path", "cat_type", "idx", "val")
    queries = (vecs.where(F.col("id").startswith("p:"))
               .select(F.substr("id", F.lit(3)).alias("uid"), "idx", "val"))
    hits = K.nearest(queries, items, metric="dot", round_digits=10, sparse_dim=dim)
    return hits.select(F.col("uid").alias("_id"), F.col("path").alias("category"))


@query
def words_products_direct(spark: SparkSession, d: str) -> DataFrame:
    """Products (T9) and category documents by mean word vector, nearest document."""
    return C.classify_with_word_vectors(X.prod(spark, d), X.cat(spark, d), X.word_vecs(spark, d), 64,
                                        round_digits=9)


@query
def overlay_trained(spark: SparkSession, d: str) -> DataFrame:
    """J6/U-D: pretrained vectors over trained ones, pretrained words outside the
    vocabulary kept.  The trained table here is the vocabulary with a vector
    of the word's length."""
    vocab = W.vocabulary(W.build_corpus(X.cat(spark, d), X.prod(spark, d)))
    trained = vocab.select("word", F.array(F.length("word").cast("double")).alias("vec"))
    o = W.overlay(vocab, trained, X.word_vecs(spark, d), keep_pretrained=True)
    return o.select("word", "count", "pretrained", F.size("vec").cast("long").alias("dim"),
                    F.round(F.try_element_at("vec", F.lit(1)), 6).alias("v1"))


# --------------------------------------------------------------------------- physical forms of the search, nulls


@query
def knn_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Several item blocks, merged lists."""
    h = K.knn(X.vec_queries(spark, d), X.vec_items(spark, d), 10, by_type=True, block_rows=32)
    return _hits_out(h, "cat_type")


@query
def knn_waves(spark: SparkSession, d: str) -> DataFrame:
    """The item side over the broadcast bound: waves of blocks."""
    h = K.knn(X.vec_queries(spark, d), X.vec_items(spark, d), 10, by_type=True, block_rows=32,
              broadcast_bytes=20_000)
    return _hits_out(h, "cat_type")


@query
def mmr_blocks(spark: SparkSession, d: str) -> DataFrame:
    """MMR on merged candidates of several blocks and waves."""
    m = ("m1",)
    h = K.search(X.vec_queries(spark, d, m), X.vec_items(spark, d, m), 3, methods=("mmr",), by_type=True,
                 block_rows=32, broadcast_bytes=20_000)
    return h.select("uid", "model", "cat_type", F.col("rank").cast("long").alias("rank"),
                    F.col("mmr_step").cast("long").alias("mmr_step"), "doc_ord", "path",
                    F.round("distance", 6).alias("distance"))


@query
def knn_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Items in the workers, in blocks around pivots that bounds can skip."""
    h = K.knn(X.vec_queries(spark, d), X.vec_items(spark, d), 10, by_type=True, pivot_rows=1)
    return _hits_out(h, "cat_type")


@query
def knn_pruned_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The same on the unit vectors of a cosine search."""
    m = ("m1",)
    h = K.knn(X.vec_queries(spark, d, m), X.vec_items(spark, d, m), 5, by_type=True, metric="cosine", pivot_rows=1)
    return _hits_out(h, "cat_type")


@query
def mmr_pruned(spark: SparkSession, d: str) -> DataFrame:
    """MMR on the candidates that a pruned search finds."""
    m = ("m1",)
    h = K.search(X.vec_queries(spark, d, m), X.vec_items(spark, d, m), 3, methods=("mmr",), by_type=True,
                 pivot_rows=1)
    return h.select("uid", "model", "cat_type", F.col("rank").cast("long").alias("rank"),
                    F.col("mmr_step").cast("long").alias("mmr_step"), "doc_ord", "path",
                    F.round("distance", 6).alias("distance"))


@query
def knn_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a vector take no part; a null path is an ordinary value."""
    q = X.vec_queries(spark, d).withColumn("vec", F.when(F.col("uid").cast("long") % 7 != 0, F.col("vec")))
    i = X.vec_items(spark, d)
    i = i.withColumns({"vec": F.when(F.col("doc_ord") % 12 != 0, F.col("vec")),
                       "path": F.when(F.col("doc_ord") % 5 != 0, F.col("path"))})
    return _hits_out(K.knn(q, i, 5, by_type=True, block_rows=32, broadcast_bytes=20_000), "cat_type")


# --------------------------------------------------------------------------- column functions of vectors


@query
def vector_distances(spark: SparkSession, d: str) -> DataFrame:
    """V1/V2 as column functions: each embedding and the one after it."""
    e = X.table(spark, d, "embeddings").select("vec_id", VF.as_double("embedding").alias("a"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(n, "vec_id").select("vec_id", F.round(VF.sq_l2("a", "b"), 6).alias("l2"),
                                      F.round(VF.cosine("a", "b"), 6).alias("cos"))


@query
def vector_shapes(spark: SparkSession, d: str) -> DataFrame:
    s = VF.vector_shape(X.table(spark, d, "embeddings"), "embedding")
    return s.select("n", F.col("min_dim").cast("long").alias("min_dim"), F.col("max_dim").cast("long").alias("max_dim"))


# --------------------------------------------------------------------------- files


def _folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _category_csv(spark: SparkSession, d: str) -> str:
    path = _folder(spark, "categories")
    (X.cat(spark, d).orderBy("cat_idx").select(F.col("path").alias("cleanHandle"))
     .write.option("sep", ";").option("header", True).option("escape", '"').csv(path))
    return path


def _product_csv(spark: SparkSession, d: str) -> str:
    path = _folder(spark, "products")
    names = [F.col(dst).alias(src) for src, dst in CSV.PRODUCT_COLUMNS]
    (X.prod(spark, d).select(*names)
     .write.option("sep", ";").option("header", True).option("escape", '"').csv(path))
    return path


@query
def category_file(spark: SparkSession, d: str) -> DataFrame:
    """The category file, written in order and read back with positions."""
    return CSV.read_categories(spark, _category_csv(spark, d))


@query
def product_file(spark: SparkSession, d: str) -> DataFrame:
    """The product file, written and read back."""
    return CSV.read_products(spark, _product_csv(spark, d)).select(
        "uid", "title", "description", "vendor_category", "vendor")


@query
def product_file_split(spark: SparkSession, d: str) -> DataFrame:
    """A product file whose descriptions are whole texts with line breaks, read in byte ranges."""
    path = _folder(spark, "products-quoted")
    docs = X.table(spark, d, "documents")
    null = F.lit(None).cast("string")
    values = {"uniqueIdentifier": F.col("doc_id").cast("string"), "metaTitle": F.col("source"), "metaDescription": F.col("text")}
    (docs.select(*[values.get(src, null).alias(src) for src, _ in CSV.PRODUCT_COLUMNS])
     .write.option("sep", ";").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return CSV.read_products(spark, path, split=True).select(
        "uid", "title", F.length("description").cast("long").alias("n_chars"), F.md5("description").alias("digest"))


@query
def product_docs(spark: SparkSession, d: str) -> DataFrame:
    """Product documents with their positions."""
    p = X.prod(spark, d).select("uid", TX.product_text("title", "vendor_category").alias("text"))
    return D.product_documents(p).select("uid", "prod_idx", "source", "text")


@query
def answers_file(spark: SparkSession, d: str) -> DataFrame:
    """K1/K2: answers written in three slice files and read back."""
    path = _folder(spark, "answers")
    A.write_answers(C.classify_direct(X.vec_queries(spark, d), X.vec_items(spark, d)), path, slices=3)
    return A.read_answers(spark, path)


@query
def answers_parts(spark: SparkSession, d: str) -> DataFrame:
    """K1: the one-array form of any size, as ordered parts of 100 answers."""
    return A.answers_as_parts(C.classify_direct(X.vec_queries(spark, d), X.vec_items(spark, d)), 100)


@query
def word_vectors_file(spark: SparkSession, d: str) -> DataFrame:
    """Word vectors as a text file, read, stored as a table, read again."""
    text, saved = _folder(spark, "vectors-text"), _folder(spark, "vectors-table")
    wv = X.word_vecs(spark, d)
    wv.select(F.concat_ws(" ", "word", F.array_join(F.col("vec").cast("array<string>"), " "))).write.text(text)
    WV.save_word_vectors(WV.read_word2vec_text(spark, text, dim=64), saved)
    return WV.load_word_vectors(spark, saved).select(
        "word", F.size("vec").cast("long").alias("dim"), F.round(F.element_at("vec", 1), 6).alias("v1"),
        F.round(F.element_at("vec", -1), 6).alias("vlast"))


@query
def word_vectors_counts(spark: SparkSession, d: str) -> DataFrame:
    """A file with lines of another width is read and stored; its counts are those
    of the scan that stored it."""
    text = _folder(spark, "vectors-text")
    wv = X.word_vecs(spark, d).withColumn("vec", F.when(F.length("word") % 5 == 0, F.slice("vec", 1, 63)).otherwise(
        F.col("vec")))
    wv.select(F.concat_ws(" ", "word", F.array_join(F.col("vec").cast("array<string>"), " "))).write.text(text)
    vecs, seen = WV.read_word2vec_counted(spark, text, 64)
    WV.save_word_vectors(vecs, _folder(spark, "vectors-table"))
    return spark.createDataFrame([tuple(seen.get[c] for c in ("lines", "words", "headers", "bad"))],
                                 "n_lines long, n_words long, n_headers long, n_bad long")


@query
def store_new_counts(spark: SparkSession, d: str) -> DataFrame:
    """New documents per collection and run, counted by the writes."""
    store = S.VectorStore(spark, _folder(spark, "store"))
    docs = _store_docs(spark, d).select("id", "text")
    models = {m: _hashing_embedder(4) for m in STORE_MODELS}
    runs = [store.add_missing(docs.where("length(text) % 2 = 0"), S.PRODUCTS, {STORE_MODELS[0]: models[STORE_MODELS[0]]}),
            store.add_missing(docs, S.PRODUCTS, models)]
    return spark.createDataFrame([(i, m, n) for i, run in enumerate(runs) for m, n in run.items()],
                                 "run long, model string, n_new long")


@query
def store_drops(spark: SparkSession, d: str) -> DataFrame:
    """K6/K7: one collection dropped, one side reset; what is left is counted."""
    store = S.VectorStore(spark, _folder(spark, "store"))
    docs = _store_docs(spark, d).select("id", "text")
    models = {m: _hashing_embedder(4) for m in STORE_MODELS}
    store.add_missing(docs, S.PRODUCTS, models)
    store.add_missing(docs.where("length(text) % 2 = 0"), S.CATEGORIES, models)
    store.drop(S.PRODUCTS, STORE_MODELS[0])
    store.reset(S.CATEGORIES)
    store.add_missing(docs.where("length(text) % 3 = 0"), S.CATEGORIES, {STORE_MODELS[1]: _hashing_embedder(4)})
    return store.counts()


# --------------------------------------------------------------------------- texts searched as they come (J2 L4 J3), the whole job

#: A text as counts of some letters: a model that SQL can repeat.
LETTERS = "aeinorst"


def _letters(df: DataFrame) -> DataFrame:
    count = lambda c: (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double")
    return df.withColumn("vec", F.array(*[count(c) for c in LETTERS]))


@query
def texts_search(spark: SparkSession, d: str) -> DataFrame:
    """Texts embedded on the fly, against category documents from a store."""
    store = S.VectorStore(spark, _folder(spark, "store"))
    store.add_missing(D.category_documents(X.cat(spark, d)), S.CATEGORIES, {"letters": _letters})
    items = store.vectors(S.CATEGORIES, "letters").drop("model")
    texts = X.prod(spark, d).select("uid", F.col("title").alias("text"))
    h = C.search_texts(texts, _letters, items, k=3, methods=("sim",))
    return _hits_out(h, "cat_type")


def _load_letters():
    """The letter counts as a model in Python."""
    return lambda texts: [[t.count(c) for c in LETTERS] for t in texts]


@query
def model_search(spark: SparkSession, d: str) -> DataFrame:
    """Both sides embedded by a model that is loaded once per worker; equal texts once."""
    embed = EM.loaded_model(_load_letters)
    items = embed(D.category_documents(X.cat(spark, d)))
    texts = X.prod(spark, d).select("uid", F.col("vendor_category").alias("text"))
    return _hits_out(C.search_texts(texts, embed, items, k=3, methods=("sim",)), "cat_type")


@query
def classify_files(spark: SparkSession, d: str) -> DataFrame:
    """The whole job from two CSV files to the answer folder."""
    return C.classify_files(spark, _category_csv(spark, d), _product_csv(spark, d), _folder(spark, "store"),
                            {"letters:v1": _letters}, _folder(spark, "answers"), approach="direct")


# --------------------------------------------------------------------------- streaming


def _drops(spark: SparkSession, d: str, base: str):
    """The embedder and two file drops: the first also holds other texts for some
    documents of the second (edited later) and each row of some documents twice."""
    docs = X.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("uid"), "text",
                                                 "doc_id")
    wv = X.word_vecs(spark, d)

    def embed(df: DataFrame) -> DataFrame:
        mv = W.mean_vectors(df, "id", F.col("text"), wv, 64)
        return df.select("id", "uid").join(mv.select("id", "vec"), "id")

    drops = []
    for drop in (0, 1):
        rows = docs.where(F.col("doc_id") % 2 == drop)
        rows = rows.unionByName(rows.where("doc_id % 6 < 2"))
        if drop == 0:
            old = docs.where("doc_id % 10 = 1").withColumn("text", F.reverse("text"))
            rows = rows.unionByName(old)
        drops.append(rows.drop("doc_id"))
    return embed, drops


@query
def stream_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Documents arrive in file drops; each micro-batch embeds (mean word
    vectors) and classifies only texts not stored yet.  The answer table equals the
    one-batch ``words_direct``: one answer per document, that of its newest text."""
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    embed, drops = _drops(spark, d, base)
    items = X.vec_items(spark, d)
    for rows in drops:
        rows.write.mode("append").option("compression", "zstd").parquet(f"{base}/src")
        ST.run_available(spark, f"{base}/src", "uid string, text string", f"{base}/store",
                         f"{base}/ckpt", "principal", embed, items)
    return ST.answers(spark, f"{base}/store", "principal")


@query
def stream_newest(spark: SparkSession, d: str) -> DataFrame:
    """The same drops, the newest text of each document held as streaming state; the
    answers are read from the state and the store."""
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    embed, drops = _drops(spark, d, base)
    items = X.vec_items(spark, d)
    for rows in drops:
        rows.write.mode("append").option("compression", "zstd").parquet(f"{base}/src")
        SN.run_available(spark, f"{base}/src", "uid string, text string", f"{base}/store",
                         f"{base}/ckpt", "principal", embed, items)
    return SN.answers(spark, f"{base}/store", "principal", f"{base}/ckpt")
