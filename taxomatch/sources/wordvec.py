"""Word vector files and tables.

* ``read_word2vec_text``: the plain-text word2vec / GloVe format, one word and
  its numbers per line, optionally a first line ``<count> <dim>``.  Read with
  ``spark.read.text`` (split across tasks like any text file); the header line
  is recognised by its field count.  The binary format is not read.
* ``save_word_vectors`` / ``load_word_vectors``: the ``word, vec`` table as
  Parquet.
* ``load_mllib_model``: vectors of a saved MLlib ``Word2VecModel``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read_word2vec_text(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """``word string, vec array<double>``; lines with another width are left out
    (``bad_lines`` lists them).

    ``dim=None`` takes the width of the first line of the first file (its
    header ``count dim``, or the first vector line).
    """
    lines = spark.read.text(path)
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    if dim is None:
        first = parts.limit(1).collect()
        if not first:
            return spark.createDataFrame([], "word string, vec array<double>")
        p = first[0]["p"]
        dim = int(p[1]) if len(p) == 2 else len(p) - 1
    vecs = parts.where(F.size("p") == dim + 1)
    if dim == 1:  # a header looks like a word with one number there
        vecs = vecs.where(~((F.element_at("p", 2) == "1") & F.element_at("p", 1).rlike("^[0-9]+$")))
    vec = F.transform(F.slice("p", 2, dim), lambda x: x.try_cast("double"))
    return vecs.select(F.element_at("p", 1).alias("word"), vec.alias("vec")).where(
        F.forall("vec", lambda x: x.isNotNull()))


def read_word2vec_counted(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame, Observation]:
    """The rows of ``read_word2vec_text`` and an ``Observation`` of the same scan.

    After the first action that reads the whole frame (e.g. ``save_word_vectors``),
    ``observation.get`` has ``lines``, ``words``, ``headers`` and ``bad`` (lines that are
    neither; an empty line is one).  There is no second pass.  A scan whose tasks feed a
    shuffle may count a task twice if an executor is lost; one that feeds a write does not.
    """
    p = F.split(F.trim("value"), r"\s+")
    vec = F.transform(F.slice("p", 2, dim), lambda x: x.try_cast("double"))
    header = F.trim("value").rlike(rf"^[0-9]+\s+{dim}$") & (F.lit(True) if dim != 1 else F.element_at("p", 2) == "1")
    word = ~header & (F.size("p") == dim + 1) & F.forall("vec", lambda x: x.isNotNull())
    lines = (spark.read.text(path).withColumn("p", p).withColumn("vec", vec)
             .select(F.element_at("p", 1).alias("word"), "vec",
                     F.when(header, "header").when(word, "word").otherwise("bad").alias("kind")))
    seen = Observation()
    counted = lines.observe(seen, F.count(F.lit(1)).alias("lines"), *[
        F.count_if(F.col("kind") == kind).alias(name)
        for kind, name in (("word", "words"), ("header", "headers"), ("bad", "bad"))])
    return counted.where("kind = 'word'").select("word", "vec"), seen


def bad_lines(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``value``: the lines of a text file that are neither a word with ``dim``
    numbers nor a header ``<count> <dim>``."""
    p = F.split(F.trim("value"), r"\s+")
    numbers = F.forall(F.slice(p, 2, dim), lambda x: x.try_cast("double").isNotNull())
    header = F.trim("value").rlike(rf"^[0-9]+\s+{dim}$")
    return spark.read.text(path).where(~header & ((F.size(p) != dim + 1) | ~numbers))


def save_word_vectors(word_vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K8: store a ``word, vec`` table."""
    word_vectors.select("word", F.col("vec").cast("array<double>")).write.mode(mode).parquet(path)


def load_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by ``save_word_vectors``."""
    return spark.read.parquet(path)


def load_mllib_model(path: str) -> DataFrame:
    """Vectors of a saved ``pyspark.ml.feature.Word2VecModel``."""
    from pyspark.ml.feature import Word2VecModel
    from pyspark.ml.functions import vector_to_array

    m = Word2VecModel.load(path)
    return m.getVectors().select("word", vector_to_array("vector").alias("vec"))
