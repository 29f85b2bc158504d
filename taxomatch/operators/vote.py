"""Rank-decayed votes and the winner of each product (W1, W2, A1-A4, U-A, U-B).

A hit of rank r in a list of length k is worth ``k - 0.45 (r - 1)`` votes.
Votes are kept as integer centivotes ``100 k - 45 (r - 1)`` so that sums are
exact and independent of the order of addition.  The winner of a product is
the path with the largest total; on equal totals the smaller path wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the voting rule: a list of k hits starts at k votes and each
# next rank gets 0.45 fewer.  Stored x100 as integers.
VOTE_STEP_CENTI = 45


def centivotes(k: int, rank: Column | str = "rank") -> Column:
    r = F.col(rank) if isinstance(rank, str) else rank
    return (F.lit(100 * k) - F.lit(VOTE_STEP_CENTI) * (r - 1)).cast("long")


def rank_votes(hits: DataFrame, k: int) -> DataFrame:
    """Add ``centivotes`` to every hit (its ``rank`` is W1)."""
    return hits.withColumn("centivotes", centivotes(k))


def union_lists(*lists: DataFrame) -> DataFrame:
    """U-A / U-B: stack hit lists of several methods, types or models (UNION ALL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)


def vote_box(voted: DataFrame) -> DataFrame:
    """A1/A2: total centivotes and number of hits per (uid, path)."""
    return voted.groupBy("uid", "path").agg(
        F.sum("centivotes").alias("centivotes"), F.count(F.lit(1)).alias("n_hits"))


def vote_winner(box: DataFrame) -> DataFrame:
    """A3: the path with the most votes per uid (ties: smaller path).

    ``min_by`` is a hash aggregate with a partial step before the shuffle.
    """
    return box.groupBy("uid").agg(
        F.min_by("path", F.struct((-F.col("centivotes")).alias("nv"), F.col("path"))).alias("category"),
        F.max("centivotes").alias("centivotes"),
        F.count(F.lit(1)).alias("n_candidates"),
    )


def vote_map(box: DataFrame) -> DataFrame:
    """A4: the whole vote box of a product as a sorted ``map<path, centivotes>``.

    For reports; a product has at most (lists x k) entries.
    """
    return box.groupBy("uid").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "centivotes")))).alias("box"))


def answers(winners: DataFrame) -> DataFrame:
    """One answer row per product: ``_id``, ``category``.

    J8: id and answer travel together in one row keyed by ``uid``; nothing is
    paired by position.
    """
    return winners.select(F.col("uid").alias("_id"), F.col("category"))
