"""Word jobs of the word-vector variant (A6, P8, P9, J5, J6, V3, V4, U-D,
U-E, C5, C6).

corpus       : sent_id string, tokens array<string>
word_vectors : word string, vec array<double>
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxomatch.functions import text as TX
from taxomatch.operators.rows import spread, with_row_index
from taxomatch.session import materialize

# Fixed values of the reference's training set-up: words seen fewer than
# twice are left out of the vocabulary, 10 training epochs.
MIN_COUNT = 2
EPOCHS = 10
# Word vector tables up to this size are broadcast to the token side (the driver holds such a
# table several times over: 197 MB of vectors failed under a heap of 750 MB).
BROADCAST_BYTES = 64 << 20


#: A word with a larger share of all tokens than one in so many is hot.
HOT_SHARE = 1000
#: Words a summary tracks.  Its counts are off by at most 3.5 / HOT_TRACKED of all tokens
#: (0.0002, a fifth of the hot share), so no word above 1.3 times that share is missed.
HOT_TRACKED = 1 << 14
#: A hot word's tokens are dealt to so many join keys.
HOT_PARTS = 64


def hot_words(tokens: DataFrame, word: str = "word") -> list[str]:
    """The words that may have more than 1 / ``HOT_SHARE`` of the tokens, at most
    2 x ``HOT_SHARE``: one pass with a mergeable frequent-items summary (a partial
    aggregate of bounded size per task; no shuffle of the tokens)."""
    row = tokens.agg(F.count(word).alias("n"),
                     F.expr(f"approx_top_k({word}, {2 * HOT_SHARE}, {HOT_TRACKED})").alias("top")).first()
    least = row.n / HOT_SHARE - row.n * 3.5 / HOT_TRACKED
    return [r["item"] for r in row.top or [] if r["item"] is not None and r["count"] >= max(least, 1)]


def _fits(words: DataFrame, width: int, limit: int | None) -> bool:
    return words.count() * width <= (BROADCAST_BYTES if limit is None else limit)


def join_words(tokens: DataFrame, words: DataFrame, how: str = "inner", width: int = 64,
               limit: int | None = None) -> DataFrame:
    """Tokens (``key, pos, word``) joined with a table of one row per ``word``.

    Tokens are skewed (a frequent word is a hot key), so the table is broadcast when its
    size - counted, rows x ``width`` bytes - is at most ``limit``.  Beyond that the join
    shuffles on ``(word, part)``: tokens of a hot word are dealt to ``HOT_PARTS`` parts,
    its row of ``words`` is repeated for each (at most 2 x ``HOT_SHARE`` x ``HOT_PARTS``
    rows more).
    """
    if _fits(words, width, limit):
        return tokens.join(F.broadcast(words), "word", how)
    hot = hot_words(tokens)
    if not hot:
        return tokens.join(words, "word", how)
    is_hot = F.col("word").isin(hot)
    part = F.when(is_hot, F.pmod(F.xxhash64("key", "pos"), F.lit(HOT_PARTS)).cast("int")).otherwise(F.lit(0))
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    return (tokens.withColumn("_part", part)
            .join(words.withColumn("_part", F.explode(parts)), ["word", "_part"], how).drop("_part"))


def sentences(df: DataFrame, key: str, text: Column | str, cat: bool = False,
              chunk: int = TX.CHUNK_WORDS) -> DataFrame:
    """Clean (T11), drop empty texts (P5), cut into chunks of ``chunk`` words
    (G5) and tokenise (G6): one row per chunk."""
    t = spread(df).select(F.col(key).cast("string").alias("key"),
                          TX.clean_words(text, cat=cat).alias("w"))
    # an empty text has no chunk (P5)
    ch = TX.explode_tokens(t, TX.chunk_words(F.col("w")), "tokens", "chunk_no", "key")
    return ch.select(F.concat_ws("#", "key", F.col("chunk_no").cast("string")).alias("sent_id"), "tokens")


def build_corpus(categories: DataFrame, products: DataFrame) -> DataFrame:
    """C5/U-E: category paths (cleaned as paths) and product texts (T10) in one corpus."""
    c = sentences(categories.withColumn("key", F.concat(F.lit("c:"), F.col("cat_idx").cast("string"))),
                  "key", F.col("path"), cat=True)
    p = sentences(products.withColumn("key", F.concat(F.lit("p:"), F.col("uid"))), "key",
                  TX.corpus_text("title", "description", "vendor_category"))
    return c.unionByName(p)


def vocabulary(corpus: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, count`` of the corpus, words seen at least ``min_count`` times.

    A hash aggregate with a partial step, so a very frequent word is summed
    before the shuffle.
    """
    return (TX.explode_tokens(corpus, F.col("tokens"), "word")
            .groupBy("word").agg(F.count(F.lit(1)).alias("count"))
            .where(F.col("count") >= min_count))


def corpus_size(corpus: DataFrame) -> DataFrame:
    """Number of sentences and tokens of the corpus."""
    return corpus.agg(F.count(F.lit(1)).alias("n_sentences"),
                      F.sum(F.size("tokens")).cast("long").alias("n_tokens"))


def overlay(vocab: DataFrame, trained: DataFrame | None, pretrained: DataFrame,
            keep_pretrained: bool = False) -> DataFrame:
    """J6/U-D: corpus vocabulary with pretrained vectors laid over trained ones.

    ``vec`` = pretrained vector when the word has one, else the trained one
    (null when neither).  ``keep_pretrained`` also adds the pretrained words
    that are not in the corpus vocabulary.
    """
    pre = pretrained.select("word", F.col("vec").alias("pre_vec"))
    how = "full" if keep_pretrained else "left"
    out = vocab.join(pre, "word", how)
    if trained is not None:
        out = out.join(trained.select("word", F.col("vec").alias("own_vec")), "word", "left")
        vec = F.coalesce("pre_vec", "own_vec")
    else:
        vec = F.col("pre_vec")
    return out.select("word", "count", vec.alias("vec"), F.col("pre_vec").isNotNull().alias("pretrained"))


def _positions(docs: DataFrame, key: str, text: Column | str, cat: bool) -> DataFrame:
    w = spread(docs).select(F.col(key).alias("key"), TX.clean_words(text, cat=cat).alias("w"))
    return TX.explode_tokens(w, F.col("w"), "word", "pos", "key")


def mean_vectors(docs: DataFrame, key: str, text: Column | str, word_vectors: DataFrame, dim: int,
                 cat: bool = False, broadcast_bytes: int | None = None) -> DataFrame:
    """Mean of the vectors of the known words of each text.

    ``key, vec array<double>, known_words long``; a text without a known word
    gets the zero vector of size ``dim`` and ``known_words = 0`` (Q13).

    Vectors that single precision holds exactly travel in it and are summed in double.
    A table of at most ``broadcast_bytes`` is broadcast to the tokens (``join_words``) and
    every number of the vector is one plain sum, so the aggregate keeps flat rows in a hash
    map: a text is summed in its map task and one row per text and task is shuffled.  A
    larger table is joined by shuffle, see ``_means_dealt``.  A word whose vector is null
    is known but no part of the mean.
    """
    toks = _positions(docs, key, text, cat)
    wv = word_vectors.select("word", F.col("vec").cast("array<double>").alias("v"))
    exact = F.forall("v", lambda x: x.cast("float").cast("double").eqNullSafe(x))
    table = wv.agg(F.count(F.lit(1)).alias("n"), F.count_if(~exact).alias("double")).first()
    if not table.double:
        wv = wv.withColumn("v", F.col("v").cast("array<float>"))
    width = (8 if table.double else 4) * (dim or 0) + 64
    if table.n * width <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        known = toks.join(F.broadcast(wv), "word")
        sums = known.groupBy("key").agg(*[F.sum(F.get("v", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(dim)],
                                        F.count("v").alias("n"), F.count(F.lit(1)).alias("known_words"))
        vec = F.array(*[F.col(f"s{i}") / F.col("n") for i in range(dim)])
        means = sums.select("key", F.when(F.col("n") > 0, vec).alias("vec"), "known_words")
    else:
        means = _means_dealt(toks, wv, dim, width, broadcast_bytes)
    keys = docs.select(F.col(key).alias("key"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return (keys.join(means, "key", "left")
            .select(F.col("key").alias(key), F.coalesce("vec", zero).alias("vec"),
                    F.coalesce("known_words", F.lit(0)).cast("long").alias("known_words")))


#: Known words of one slice of the texts (32 MB of numbers in the worker, and their vectors).
SLICE_WORDS = 8_000_000
#: Bytes of vectors that are summed in one step.
STEP_BYTES = 16 << 20


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, wids``: one row per run of a key.  A join by broadcast leaves the words of a text together."""
    for batch in batches:
        if batch.num_rows:
            key = batch.column(0)
            codes = key.dictionary_encode().indices.to_numpy()
            starts = np.r_[0, np.nonzero(np.diff(codes))[0] + 1].astype(np.int32)
            wids = pa.ListArray.from_arrays(np.r_[starts, batch.num_rows].astype(np.int32), batch.column(1))
            yield pa.RecordBatch.from_arrays([key.take(pa.array(starts)), wids], ["key", "wids"])


def _means_dealt(toks: DataFrame, wv: DataFrame, dim: int, width: int, limit: int | None = None) -> DataFrame:
    """``key, vec, known_words`` with a table of vectors too large to broadcast.

    The join that finds the known words (``join_words``: the words and their numbers are
    broadcast while they fit, else by shuffle, hot words dealt out) carries the number of a
    word, not its vector, and the numbers of a text are packed into lists.  The texts are cut
    by hash into slices of about ``SLICE_WORDS`` known words; each slice gets the vectors of
    its distinct words once and sums them per text.  So a vector travels once per slice, not
    per token, and a token as four bytes."""
    numbered = with_row_index(wv, ["word"], "wid").withColumn("wid", F.col("wid").cast("int"))
    known = join_words(toks.where(F.col("key").isNotNull()), numbered.select("word", "wid"), limit=limit)
    own = T.StructType([T.StructField("key", toks.schema["key"].dataType),
                        T.StructField("wids", T.ArrayType(T.IntegerType()))])
    known = materialize(known.select("key", "wid").mapInArrow(_packed, own), "known-words", "zstd")
    n = known.agg(F.sum(F.size("wids"))).first()[0] or 0
    slices = max(known.sparkSession.sparkContext.defaultParallelism, -(-n // SLICE_WORDS))
    known = known.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)))
    vectors = (known.select(F.col("slice").alias("part"), F.explode("wids").alias("own")).distinct()
               .join(numbered.select(F.col("wid").alias("own"), "v"), "own"))
    step = max(1, STEP_BYTES // width)

    def means(left: pa.Table, right: pa.Table) -> pa.Table:
        wid = right["own"].to_numpy()
        order = np.argsort(wid)
        v = right["v"].combine_chunks()
        there = v.is_valid().to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False)
        V = np.zeros((len(wid), dim), flat.dtype)
        V[there] = flat.reshape(-1, dim)
        keys = left["key"].combine_chunks().dictionary_encode()
        codes = keys.indices.to_numpy()
        lists = left["wids"].combine_chunks()
        ends = np.cumsum(lists.value_lengths().to_numpy())
        own = lists.flatten().to_numpy()
        known_words = np.bincount(codes, np.diff(ends, prepend=0), len(keys.dictionary)).astype(np.int64)
        n, sums = np.zeros(len(known_words)), np.zeros((len(known_words), dim))
        for s in range(0, len(own), step):
            e = min(s + step, len(own))
            place = order[np.searchsorted(wid, own[s:e], sorter=order)]
            rows = np.arange(np.searchsorted(ends, s, "right"), np.searchsorted(ends, e - 1, "right") + 1)
            starts = np.maximum(np.r_[0, ends][rows] - s, 0)
            np.add.at(n, codes[rows], np.add.reduceat(there[place].astype(np.int64), starts))
            np.add.at(sums, codes[rows], np.add.reduceat(V[place].astype(np.float64), starts, axis=0))
        vec = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * dim, (sums / np.maximum(n, 1)[:, None]).ravel())
        return pa.table({"key": keys.dictionary, "vec": vec, "known_words": known_words})

    schema = T.StructType([T.StructField("key", toks.schema["key"].dataType),
                           T.StructField("vec", T.ArrayType(T.DoubleType())),
                           T.StructField("known_words", T.LongType())])
    return known.groupBy("slice").cogroup(vectors.groupBy("part")).applyInArrow(means, schema)


def known_words(docs: DataFrame, key: str, text: Column | str, word_vectors: DataFrame,
                cat: bool = False, as_list: bool = False, broadcast_bytes: int | None = None) -> DataFrame:
    """V4: the words of each text that have a vector, in text order.

    One row per known word: ``key, pos, word`` (``pos`` = position among the
    cleaned tokens), so a huge text is never gathered into one row.
    ``as_list=True`` gives one ``words`` array per text instead - only for
    texts of bounded length.
    """
    toks = _positions(docs, key, text, cat)
    known = join_words(toks, word_vectors.select("word"), "left_semi", limit=broadcast_bytes)
    known = known.select(F.col("key").alias(key), "pos", "word")
    if not as_list:
        return known
    return (known.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("s"))
            .select(key, F.transform("s", lambda x: x["word"]).alias("words")))


def train_word2vec(corpus: DataFrame, vector_size: int = 100, min_count: int = MIN_COUNT,
                   epochs: int = EPOCHS, window: int = 5, seed: int = 42,
                   partitions: int | None = None) -> DataFrame:
    """MLlib Word2Vec (skip-gram) on the corpus -> ``word_vectors``.

    ``partitions`` defaults to the parallelism of the cluster (MLlib's own
    default, 1, would train the whole corpus in one task); each partition
    trains on its sentences and the updates are averaged per epoch.
    MLlib holds the vocabulary and both weight matrices (vocabulary x
    ``vector_size`` floats each) on the driver and sends them to the executors
    every epoch, so the vocabulary, not the corpus, has to fit; raise
    ``min_count`` for a larger one.
    MLlib has no warm start from pretrained vectors; lay them over the result
    with ``overlay`` (the two spaces are not aligned, so a table should hold
    either overlaid or trained words per model).
    """
    if partitions is None:
        partitions = corpus.sparkSession.sparkContext.defaultParallelism
    w2v = Word2Vec(vectorSize=vector_size, minCount=min_count, maxIter=epochs, windowSize=window,
                   maxSentenceLength=TX.CHUNK_WORDS,  # a chunk is one sentence, never cut again
                   seed=seed, numPartitions=partitions, inputCol="tokens", outputCol="_v")
    model = w2v.fit(corpus.select("tokens"))
    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))

