"""Embedding providers (U1): turn a text column into a vector column.

* ``precomputed``  - vectors already in a table: an equi-join on the key.
* ``tfidf``        - exact TF-IDF with MLlib's smoothing, ``idf = ln((N+1)/(df+1))``,
                     L2-normalised over *all* terms of a document, kept sparse
                     on the vocabulary of the category side (the only terms
                     that can add to a product-category dot product).
* ``mean_words``   - mean word vectors (``operators.words.mean_vectors``).
* ``pandas_model`` - any model as a pandas UDF ``Series[str] -> Series[array]``,
                     run on Arrow batches.
* ``loaded_model`` - a model that is costly to load: loaded once per Python worker,
                     equal texts embedded once.

The reference calls model servers over HTTP; no client for them is built.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxomatch.functions import text as TX
from taxomatch.operators.rows import spread, with_row_index
from taxomatch.operators.words import mean_vectors
from taxomatch.session import materialize


def precomputed(docs: DataFrame, vectors: DataFrame, on: str = "id") -> DataFrame:
    """Join stored vectors (``on``, ``vec``) to the documents."""
    return docs.join(vectors.select(on, "vec"), on)


# Tables of terms up to this many rows are broadcast (~100 B a row).
BROADCAST_TERMS = 2_000_000
# A larger table is joined by shuffle, but for the terms with this share of all rows.
HOT_SHARE = 100_000


def join_terms(rows: DataFrame, terms: DataFrame, limit: int | None = None,
               share: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``terms`` (``term``, ``df``, ...) joined on ``term``.

    A frequent term is a hot key: beyond ``limit`` terms, those with at least
    1 / ``share`` of all occurrences (so at most ``share`` of them) are
    broadcast and only the rows of the others are shuffled."""
    share = share or HOT_SHARE
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.sum("df").alias("total")).first()
    if size.n <= (BROADCAST_TERMS if limit is None else limit):
        return rows.join(F.broadcast(terms), "term").drop("df")
    hot = F.col("df") * share >= F.lit(size.total)
    frequent = F.broadcast(terms.where(hot))
    rare = rows.join(frequent.select("term"), "term", "left_anti").join(terms.where(~hot), "term")
    return rows.join(frequent, "term").unionByName(rare).drop("df")


def term_weights(docs: DataFrame, key: str = "id", text: Column | str = "text",
                 cat: bool = False) -> DataFrame:
    """Normalised TF-IDF weights ``key, term, w`` over the documents given.

    Term frequencies, document frequencies and norms are three hash
    aggregates; the idf table has one row per term.
    """
    toks = TX.explode_tokens(spread(docs).select(F.col(key).alias("key"),
                                                 TX.clean_words(text, cat=cat).alias("w")),
                             F.col("w"), "term", None, "key")
    tf = toks.groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    n_docs = docs.select(key).count()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", "df", F.log((F.lit(n_docs) + 1.0) / (F.col("df") + 1.0)).alias("idf"))
    w = join_terms(tf, materialize(idf, "term-counts")).select("key", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return (w.join(norm, "key").where(F.col("norm") > 0)
            .select(F.col("key").alias(key), "term", (F.col("w") / F.col("norm")).alias("w")))


def tfidf(docs: DataFrame, vocab_from: Column, key: str = "id", text: Column | str = "text") -> tuple[DataFrame, int]:
    """Sparse TF-IDF vectors for every document: ``key, idx array<int>, val array<double>``
    and the dimension (size of the vocabulary).

    ``vocab_from`` selects the documents whose terms span the vector (the
    category side); a document with none of those terms gets empty arrays
    (the zero vector).  Search them with ``knn.search(..., sparse_dim=dim)``:
    they stay sparse until a block is scored.

    The weights feed the vocabulary index, the size checks of the search and
    the search itself, so the sparse result is written once to the session's
    checkpoint folder instead of being recomputed by each.
    """
    weights = term_weights(docs, key, text).persist()
    vocab_keys = docs.where(vocab_from).select(F.col(key))
    used = (weights.join(vocab_keys, key, "left_semi").where(F.col("w") > 0)
            .select("term").distinct())
    terms = with_row_index(used, ["term"], "t_idx")
    counts = weights.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = materialize(terms.join(counts, "term"), "tfidf-terms")
    dim = terms.count()
    packed = (join_terms(weights, terms)
              .groupBy(key)
              .agg(F.collect_list(F.col("t_idx").cast("int")).alias("i"), F.collect_list("w").alias("v")))
    sparse = (docs.select(key).join(packed, key, "left")
              .select(key, F.coalesce("i", F.array().cast("array<int>")).alias("idx"),
                      F.coalesce("v", F.array().cast("array<double>")).alias("val")))
    sparse = materialize(sparse, "tfidf-vectors")
    weights.unpersist()
    return sparse, dim


def mean_words(docs: DataFrame, word_vectors: DataFrame, dim: int, key: str = "id",
               text: Column | str = "text") -> DataFrame:
    return mean_vectors(docs, key, text, word_vectors, dim).select(key, "vec")


def pandas_model(fn: Callable[[pd.Series], pd.Series]) -> Callable[[DataFrame], DataFrame]:
    """Wrap a batch function ``texts -> vectors`` as an embedder for the store."""
    udf = F.pandas_udf(fn, "array<double>")

    def embed(df: DataFrame) -> DataFrame:
        return df.withColumn("vec", udf(F.col("text")))
    return embed


#: Vectors of up to so many texts (some 100 MB at 768 numbers) are broadcast back to the rows.
BROADCAST_VECTORS = 20_000
#: Models a worker keeps; the one loaded first goes.
KEPT_MODELS = 2


def worker_model(name: str, load: Callable):
    """The model ``name`` of this Python worker, loaded on its first use.

    Functions of this package travel by value, so a module global would be new in
    every task; the models hang on the interpreter, which Spark reuses between tasks."""
    kept = sys.modules.setdefault("_taxomatch_models", types.ModuleType("_taxomatch_models")).__dict__.setdefault(
        "kept", {})
    if name not in kept:
        while len(kept) >= KEPT_MODELS:
            kept.pop(next(iter(kept)))
        kept[name] = load()
    return kept[name]


def loaded_model(load: Callable[[], Callable[[list[str]], list]], name: str | None = None
                 ) -> Callable[[DataFrame], DataFrame]:
    """An embedder for a model that is costly to load.

    ``load()`` gives a function from a list of texts to their vectors; it runs once per
    Python worker and ``name`` (default: one name per embedder), not once per batch or
    task.  Equal texts are embedded once: texts are made distinct (a partial aggregate, so
    a hot text is one row per task), their vectors written once and joined back by
    SHA-256 of the text, the few texts that make up a large share of the rows by broadcast.
    A null text is embedded as the empty one.  All columns of the rows are kept; a column
    ``vec`` is replaced.
    """
    name = name or uuid.uuid4().hex

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = worker_model(name, load)
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in model(texts.tolist())], dtype=object)

    udf = F.pandas_udf(vectors, "array<double>")

    def embed(df: DataFrame) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        texts = df.groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("df"))
        terms = materialize(texts.select(F.sha2("text", 256).alias("term"), "df", udf("text").alias("vec")),
                            "model-vectors")
        rows = df.drop("vec").select(F.struct("*").alias("row"), F.sha2(text, 256).alias("term"))
        return join_terms(rows, terms, BROADCAST_VECTORS, BROADCAST_VECTORS).select("row.*", "vec")
    return embed
