"""Row positions and the row filters built on them.

A position is only asked for where the reference numbers rows.  It is made
without moving all rows through one task: rows are range-partitioned and
sorted on the order columns, each row gets its place inside its partition
(``monotonically_increasing_id`` keeps the partition in its upper bits), and
a prefix sum over the per-partition counts - one row per partition - turns
that into a global position.  Range bounds come from a sample and two uses of
one plan may sample differently, so the placed rows are written once and both
the counts and the positions are read from that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxomatch.session import materialize

_LOW_BITS = (1 << 33) - 1


_PARTITION_BYTES = 128 << 20


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimised plan (no job is run)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001
        return None


def range_partitions(df: DataFrame) -> int:
    """Range partitions for a re-numbering: one per ~128 MB of estimated input,
    at least min(cores, ``spark.sql.shuffle.partitions``).  Sized up front from
    the plan estimate (asking the RDD would run the upstream shuffles)."""
    spark = df.sparkSession
    base = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                      spark.sparkContext.defaultParallelism))
    size = estimated_bytes(df)
    if size is None:
        return base
    return int(max(base, min(size // _PARTITION_BYTES + 1, 1_000_000)))


def placed(df: DataFrame, cols: list, num_partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted on ``cols``, with ``_pid`` (the range)
    and ``_local`` (0-based place in it), written once under the checkpoint
    folder: whatever reads it sees the same ranges."""
    ranged = df.repartitionByRange(num_partitions or range_partitions(df), *cols)
    s = ranged.sortWithinPartitions(*cols).withColumn("_mid", F.monotonically_increasing_id())
    return materialize(s.withColumns({
        "_pid": F.shiftright(F.col("_mid"), 33), "_local": F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)),
    }).drop("_mid"), "placed")


def with_row_index(df: DataFrame, order: list, name: str = "idx", start: int = 0,
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based (or ``start``-based) position in ``order``.

    ``order``: column names or sort expressions (``F.desc(..)``); it should be
    unique for a stable numbering.
    """
    s = placed(df, [F.col(c) if isinstance(c, str) else c for c in order], num_partitions)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_n")).alias("_off"))
    # offsets has one row per partition: a size bound by construction.
    out = s.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_local") + F.lit(start)).cast("long")).drop(
        "_pid", "_local", "_off")


def batch_number(idx: str = "idx", size: int = 5000):
    """Batch of a row when rows are stored ``size`` at a time."""
    return F.floor(F.col(idx) / F.lit(size)).cast("long")


def every_nth(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """Rows whose position is a multiple of ``n`` (progress sample)."""
    return df.where(F.col(idx) % F.lit(n) == 0)


def position_slice(df: DataFrame, start: int, stop: int | None, idx: str = "idx") -> DataFrame:
    """Python-style slice ``[start:stop]`` on the position column."""
    cond = F.col(idx) >= F.lit(start)
    if stop is not None:
        cond = cond & (F.col(idx) < F.lit(stop))
    return df.where(cond)


def batch_report(df: DataFrame, idx: str = "idx", size: int = 5000) -> DataFrame:
    """Rows per storage batch, with the first and last position."""
    return (df.withColumn("batch", batch_number(idx, size))
            .groupBy("batch")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min(idx).alias("first_idx"),
                 F.max(idx).alias("last_idx")))


def range_slices(df: DataFrame, n: int, key: str = "uid") -> DataFrame:
    """Split the rows into ``n`` key ranges; every row is kept."""
    return df.repartitionByRange(n, key)


SPREAD_MAX_BYTES = 1 << 30


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin the rows over ``min_partitions`` partitions (default: the
    parallelism of the cluster) before CPU-heavy per-row work - but only when
    the input is small: estimated under one 128 MB split per core (so a few
    row groups would leave most cores idle) and under 1 GB (so the shuffle is
    cheap next to the work).  Larger inputs, and those of at least as many files, already
    come in enough splits and are left as they are (no shuffle: of texts it would write
    the whole input to disk).
    """
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    small = size is not None and size < min(n * _PARTITION_BYTES, SPREAD_MAX_BYTES)
    return df.repartition(n) if small and len(df.inputFiles()) < n else df
