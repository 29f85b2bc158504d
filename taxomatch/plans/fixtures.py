"""Frames derived from the driver tables (see FIXTURES.md §3).

Every derivation is a plain projection / filter / explode of the given
parquet tables, so its work grows with them; the same derivations are
written in SQL in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxomatch.operators.rows import with_row_index

# Fixed values of the fixture: the three "models" are slices of the 64-wide
# embedding (1-based, inclusive): m1 = 1..32, m2 = 33..64, principal = 1..64.
MODEL_SLICES = {"m1": (1, 32), "m2": (33, 32), "principal": (1, 64)}
ENSEMBLE_MODELS = ("m1", "m2", "principal")
# Every fourth embedding is a category document, the rest are queries, so both
# sides grow with the table.
ITEM_STEP = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def model_vectors(vec: Column, models=ENSEMBLE_MODELS) -> Column:
    """One struct(model, vec) per requested model; explode it for the long format."""
    return F.array(*[
        F.struct(F.lit(m).alias("model"),
                 F.slice(vec, MODEL_SLICES[m][0], MODEL_SLICES[m][1]).alias("vec"))
        for m in models])


def vec_items(spark: SparkSession, sf_dir: str, models=("principal",)) -> DataFrame:
    """Category documents: 2 per category (ALL, LAST by turns)."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % ITEM_STEP == 0)
    no = F.floor(F.col("vec_id") / ITEM_STEP)
    e = e.select(
        F.col("vec_id").alias("doc_ord"),
        F.concat(F.lit("cat/"), F.lpad(F.floor(no / 2).cast("string"), 19, "0")).alias("path"),
        F.when(no % 2 == 0, F.lit("ALL")).otherwise(F.lit("LAST")).alias("cat_type"),
        F.explode(model_vectors(F.col("embedding").cast("array<double>"), models)).alias("m"))
    return e.select("m.model", "doc_ord", "path", "cat_type", "m.vec")


def vec_queries(spark: SparkSession, sf_dir: str, models=("principal",)) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % ITEM_STEP != 0)
    e = e.select(F.col("vec_id").cast("string").alias("uid"),
                 F.explode(model_vectors(F.col("embedding").cast("array<double>"), models)).alias("m"))
    return e.select("m.model", "uid", "m.vec")


def cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category table ``(cat_idx, path)`` from ``part``: type--range/name.

    It stands for the stored category file, so it is written once to the
    checkpoint folder: the numbering (a few small jobs) is not repeated by
    every use.
    """
    from taxomatch.session import materialize

    p = table(spark, sf_dir, "part")
    paths = p.select(F.concat(F.lower("p_type"), F.lit("--range/"),
                              F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).alias("path")).distinct()
    return materialize(with_row_index(paths, ["path"], "cat_idx"), "cat")


def prod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product table in the reference's six-column shape, derived from ``part``."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    title = F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand"), F.lit(", size "),
                     F.col("p_size").cast("string"))
    vc = (F.when(key % 4 == 1, F.concat(F.lit("['"), F.col("p_type"), F.lit("','"), F.col("p_brand"), F.lit("']")))
          .when(key % 4 == 2, F.col("p_type"))
          .when(key % 4 == 3, F.lit("[]")))
    return p.select(
        key.cast("string").alias("uid"),
        F.when(key % 7 == 0, F.concat(F.lit("XL, "), title)).otherwise(title).alias("title"),
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")).alias("description"),
        F.lit(None).cast("string").alias("specs"),
        vc.alias("vendor_category"),
        F.col("p_brand").alias("vendor"),
    )


def word_vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pretrained-style word vectors: the vocabulary of ``documents`` (count >= 2)
    ranked by (count desc, word); the word of rank r (0-based) gets the
    embedding with ``vec_id = r`` while such a row exists.

    It stands for a stored table, so it is written once to the session's
    checkpoint folder rather than recomputed by every use.
    """
    from taxomatch.operators import words as W
    from taxomatch.session import materialize

    corpus = W.sentences(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    vocab = W.vocabulary(corpus)
    ranked = with_row_index(vocab, [F.desc("count"), F.asc("word")], "rank")
    emb = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("rank"), F.col("embedding").cast("array<double>").alias("vec"))
    return materialize(ranked.join(emb, "rank").select("word", "vec"), "word_vecs")
