"""Row positions, run counters, slices and samples."""

from pyspark.sql import functions as F

from taxomatch.operators import docs as D
from taxomatch.operators import rows as R


def test_row_index_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(9)
    got = R.with_row_index(df, ["k"], "idx").select("k", "idx").collect()
    assert sorted(r.idx for r in got) == list(range(1000))
    assert all(r.k == r.idx for r in got)


def test_row_index_desc_and_start(spark):
    df = spark.createDataFrame([("a", 3), ("b", 5), ("c", 5)], "w string, n long")
    got = {r.w: r.i for r in R.with_row_index(df, [F.desc("n"), F.asc("w")], "i", start=1).collect()}
    assert got == {"b": 1, "c": 2, "a": 3}


def test_run_counter_restarts(spark):
    keys = ["a", "a", "b", "a", "a", "a", None, None, "b"]
    df = spark.createDataFrame(list(enumerate(keys)), "idx long, key string").repartition(4)
    got = [r.n for r in D.run_counter(df, "key", "idx").orderBy("idx").collect()]
    assert got == [0, 1, 0, 0, 1, 2, 0, 1, 0]


def test_chunk_ids(spark):
    df = spark.createDataFrame([(0, 5, 2), (1, 5, 2), (2, 6, 2), (3, 5, 2)], "idx long, index long, level int")
    got = [r.id for r in D.chunk_ids(df, "f.csv", "index", "level", "idx").orderBy("idx").collect()]
    assert got == ["f.csv:5:2:0", "f.csv:5:2:1", "f.csv:6:2:0", "f.csv:5:2:0"]


def test_slices_samples_batches(spark):
    df = R.with_row_index(spark.range(0, 50).select(F.col("id").alias("v")), ["v"], "idx")
    assert [r.idx for r in R.position_slice(df, 3, 11).orderBy("idx").collect()] == list(range(3, 11))
    assert [r.idx for r in R.every_nth(df, 20).orderBy("idx").collect()] == [0, 20, 40]
    rep = {r.batch: (r.n_rows, r.first_idx, r.last_idx) for r in R.batch_report(df, "idx", 20).collect()}
    assert rep == {0: (20, 0, 19), 1: (20, 20, 39), 2: (10, 40, 49)}
    assert R.range_slices(df, 4, key="idx").rdd.getNumPartitions() == 4


def test_spread_only_small_inputs(spark):
    small = spark.range(0, 100).coalesce(1)
    assert R.spread(small, 8).rdd.getNumPartitions() == 8
    assert R.estimated_bytes(small) is not None
    assert R.spread(small, 1).rdd.getNumPartitions() == 1        # enough splits already


def test_positions_of_many_rows_with_more_columns(spark, scratch):
    """Beyond the sample of a range partitioning, with columns besides the order, after a write."""
    n = 1_000_000
    df = spark.range(0, n, numPartitions=16).select(
        (F.col("id") * 7919 % n).alias("k"), F.col("id").alias("payload"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
    R.with_row_index(df, ["k"], "idx").write.parquet(scratch)
    got = spark.read.parquet(scratch)
    r = got.agg(F.count_distinct("idx").alias("d"), F.sum((F.col("k") != F.col("idx")).cast("long")).alias("bad"),
                F.sum((F.col("payload") * 7919 % n != F.col("k")).cast("long")).alias("torn")).first()
    assert (r.d, r.bad, r.torn) == (n, 0, 0)


def test_run_counter_of_many_rows(spark, scratch):
    n = 300_000
    df = spark.range(0, n, numPartitions=9).select(
        F.col("id").alias("idx"), F.floor(F.col("id") / 5000).cast("string").alias("key"),
        F.col("id").cast("string").alias("payload"))
    D.run_counter(df, "key", "idx").write.parquet(scratch)
    got = spark.read.parquet(scratch)
    assert got.count() == n
    assert got.where(F.col("n") != F.col("idx") % 5000).count() == 0


def test_product_positions(spark, scratch):
    df = spark.range(0, 200_000, numPartitions=7).select(
        F.lpad(F.col("id").cast("string"), 7, "0").alias("uid"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    D.product_documents(df).write.parquet(scratch)
    got = spark.read.parquet(scratch)
    assert got.where(F.col("uid").cast("long") != F.col("prod_idx")).count() == 0
    assert got.select("prod_idx").distinct().count() == 200_000
