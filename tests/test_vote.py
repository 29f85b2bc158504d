"""Votes, winner and answers."""

from pyspark.sql import functions as F

from taxomatch.operators import vote as V


def test_centivotes_closed_form(spark):
    df = spark.range(1, 11).select(F.col("id").cast("int").alias("rank"))
    k5 = [r.v for r in df.where("rank <= 5").select(V.centivotes(5).alias("v")).orderBy("rank").collect()]
    assert k5 == [500, 455, 410, 365, 320] and sum(k5) == 2050
    k10 = [r.v for r in df.select(V.centivotes(10).alias("v")).collect()]
    assert k10[0] == 1000 and k10[-1] == 595 and sum(k10) == 7975


def test_tie_goes_to_smaller_path(spark):
    hits = spark.createDataFrame(
        [("u1", "b/x", 1), ("u1", "a/y", 1), ("u2", "c", 1), ("u2", "d", 2)],
        "uid string, path string, rank int")
    winners = V.vote_winner(V.vote_box(V.rank_votes(hits, 5))).collect()
    got = {r.uid: r.category for r in winners}
    assert got == {"u1": "a/y", "u2": "c"}


def test_every_product_gets_one_answer(spark):
    hits = spark.createDataFrame([(f"u{i % 7}", f"p{i % 3}", (i % 5) + 1) for i in range(200)],
                                 "uid string, path string, rank int")
    ans = V.answers(V.vote_winner(V.vote_box(V.rank_votes(hits, 5))))
    assert ans.count() == 7 and ans.select("_id").distinct().count() == 7


def test_vote_map(spark):
    hits = spark.createDataFrame([("u", "b", 1), ("u", "a", 2), ("u", "b", 2)], "uid string, path string, rank int")
    box = V.vote_map(V.vote_box(V.rank_votes(hits, 5))).first().box
    assert box == {"a": 455, "b": 955}
