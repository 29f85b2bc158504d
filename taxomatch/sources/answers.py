"""Answer sink (K1, K2).

The answer of a run is one row per product, ``_id`` and ``category``.  It is
written as JSON lines in parallel (one part file per partition - the per-slice
answer files of a sliced run are these part files).  The one-array form
``[{"_id": .., "category": ..}, ...]`` is written as ordered parts of bounded
size; as one string it is only built for at most ``MAX_ARRAY_ROWS`` answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxomatch.operators import rows as R

#: Answers that one string may hold (some 10 MB), and answers of one part of an array.
MAX_ARRAY_ROWS = 100_000
PART_ROWS = 10_000


def write_answers(answers: DataFrame, path: str, mode: str = "overwrite", slices: int | None = None) -> None:
    """K1: JSON lines, one part file per partition.

    K2: with ``slices=n`` the answers are first split into ``n`` ranges of
    ``_id``, so the folder holds one answer file per slice.
    """
    out = answers.select("_id", "category")
    if slices:
        out = out.repartitionByRange(slices, "_id")
    out.write.mode(mode).json(path)


def answers_as_array(answers: DataFrame, max_rows: int = MAX_ARRAY_ROWS) -> DataFrame:
    """One row, one column ``json``: the whole answer as one JSON array of at most
    ``max_rows`` answers, and never more than ``MAX_ARRAY_ROWS``.

    A single string of every answer is by definition one task's worth of
    data, so the size is checked first.
    """
    max_rows = min(max_rows, MAX_ARRAY_ROWS)
    n = answers.limit(max_rows + 1).count()
    if n > max_rows:
        raise ValueError(f"over {max_rows} answers: too many for one JSON array, use answers_as_parts")
    return answers.agg(F.to_json(F.array_sort(F.collect_list(F.struct("_id", "category")))).alias("json"))


def answers_as_parts(answers: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The one-array form of any number of answers: (part, json), at most
    ``part_rows`` answers by ``_id`` in each part.  The ``json`` of all parts, put
    one behind the other by ``part``, is the array; without answers it is one part.
    """
    idx = F.col("idx")
    own = R.with_row_index(answers.select("_id", "category"), ["_id", "category"]).select(
        F.floor(idx / part_rows).alias("part"), "idx", "_id", "category")
    rows = F.array_sort(F.collect_list(F.struct("idx", "_id", "category")))
    pairs = F.transform(rows, lambda x: F.struct(x["_id"].alias("_id"), x["category"].alias("category")))
    n = own.count()  # of the written positions
    if not n:
        return answers.sparkSession.createDataFrame([(0, "[]")], "part long, json string")
    parts = own.groupBy("part").agg(F.to_json(pairs).alias("json"), F.max("idx").alias("last"))
    inner = F.expr("substring(json, 2, length(json) - 2)")
    return parts.select("part", F.concat(
        F.when(F.col("part") == 0, "[").otherwise(","), inner,
        F.when(F.col("last") == n - 1, "]").otherwise("")).alias("json"))


def read_answers(spark, path: str) -> DataFrame:
    return spark.read.schema("_id string, category string").json(path)
