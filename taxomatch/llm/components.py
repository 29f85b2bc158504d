"""Connected components of a links table, by alternating large-star and
small-star steps (each a grouped minimum and an equi-join), until the edges are
stars around the smallest node of each component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxomatch.llm.common import written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` (a, b) -> (node, root): root is the smallest node that can be
    reached.  Nodes without a link to another node do not appear.  Nulls are
    left out, repeated links and both directions are allowed.  Each round is
    written under the checkpoint folder, so a lost executor repeats one round."""
    edges = (links.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    edges = written(edges, "edges")
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        # Large star: every larger neighbour is hung under the smallest one.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours are hung under the smallest.
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = (edges.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v").where("u != v").distinct())
        edges = written(edges, "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
