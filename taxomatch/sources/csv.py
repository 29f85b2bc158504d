"""Readers for the category and product files.

Both files are ``;``-separated with one header row.  Records of the product
file may hold quoted separators and quoted line breaks, so it is read with
``multiLine`` (the parser then splits on the detected record end, ``\\r``,
``\\n`` or ``\\r\\n``); a stray line-end character left in front of the first
field is trimmed and rows with an empty key are dropped.

``multiLine`` reads a file in one task.  ``records`` reads it in byte ranges
despite quoted line breaks: a line starts a record where the number of quotes
before it in the file is even.  Each range counts its quotes, a prefix sum over
the ranges (one row per range) tells whether a range starts inside a quoted
value, and every task then cuts its own lines into records.  Only the pieces of
records that reach over the end of a range are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxomatch.operators.rows import with_row_index
from taxomatch.session import materialize

# Fixed column names of the product file and the names used here.
PRODUCT_COLUMNS = (
    ("uniqueIdentifier", "uid"),
    ("metaTitle", "title"),
    ("metaDescription", "description"),
    ("metaSpecs", "specs"),
    ("vendorCategory", "vendor_category"),
    ("vendor", "vendor"),
)
PRODUCT_SCHEMA = T.StructType([T.StructField(src, T.StringType()) for src, _ in PRODUCT_COLUMNS])
SEP = ";"
_LINE_ENDS = r"^[\r\n]+|[\r\n]+$"


def _trim_line_ends(c):
    return F.regexp_replace(c, _LINE_ENDS, "")


WHOLE, LATER, FIRST = 0, 1, 2
_PIECES = "file string, block long, seq long, kind int, record string"


def _cut(line_sep: str, kinds: tuple[int, ...]):
    """Lines of ranges, in order, with ``inside`` (the range starts in a quoted value) -> whole
    records (WHOLE), the rest of a record of an earlier range (LATER) and the first
    piece of one that goes on in the next (FIRST)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None  # (file, block)
        lines: list[str] = []
        begun = inside = False
        seq = 0
        out: list[tuple] = []

        def end(kind):
            nonlocal seq
            if lines:
                if kind in kinds:
                    out.append((*at, seq, kind, line_sep.join(lines)))
                seq += 1
                lines.clear()

        for b in batches:
            for file, block, odd, value, starts_inside in zip(*[c.to_pylist() for c in b.columns]):
                if (file, block) != at:
                    end(FIRST if begun else LATER)
                    at, seq, inside, begun = (file, block), 0, starts_inside, not starts_inside
                lines.append(value)
                inside ^= odd
                if not inside:
                    end(WHOLE if begun else LATER)
                    begun = True
            yield _pieces(out)
            out.clear()
        end(FIRST if begun else LATER)
        yield _pieces(out)

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    cols = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                      names=["file", "block", "seq", "kind", "record"])


def records(spark: SparkSession, path: str, line_sep: str = "\n", header: bool = True) -> DataFrame:
    """``file, block, seq, record``: the records of quoted text files, read in byte ranges.

    Files in the usual form: a value with quotes, separators or line breaks is quoted as
    a whole, its quotes are doubled; a quote inside an unquoted value is not (read
    such files with ``multiLine``).  (file, block, seq) is the order in the files.  With
    ``header`` the first record of each file is left out, as are blank records.
    """
    lines = spark.read.option("lineSep", line_sep).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).alias("odd"), "value")
    ranges = lines.groupBy("file", "block").agg((F.count_if("odd") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # One row per range: broadcast, so that the lines stay in order.
    placed = lines.join(F.broadcast(materialize(starts, "csv-ranges")), ["file", "block"]).select("file", "block", "odd", "value", "inside")

    whole = placed.mapInArrow(_cut(line_sep, (WHOLE,)), _PIECES)
    pieces = materialize(placed.mapInArrow(_cut(line_sep, (LATER, FIRST)), _PIECES), "csv-pieces")
    # A later piece belongs to the last first piece before it.
    first = F.when(F.col("kind") == FIRST, F.struct(F.col("block"), F.col("seq")))
    since = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    owner = pieces.select("file", "block", "seq", F.last(first, ignorenulls=True).over(since).alias("own"))
    joined = (pieces.join(owner, ["file", "block", "seq"]).groupBy("file", "own")
              .agg(F.array_sort(F.collect_list(F.struct("block", "seq", "record"))).alias("p"))  # the pieces of one record
              .select("file", F.col("own.block").alias("block"), F.col("own.seq").alias("seq"),
                      F.array_join(F.transform("p", lambda x: x["record"]), line_sep).alias("record")))
    out = whole.select("file", "block", "seq", "record").unionByName(joined)
    if line_sep == "\n":  # files with \r\n
        out = out.withColumn("record", F.regexp_replace("record", r"\r$", ""))
    if header:
        out = out.where("NOT (block = 0 AND seq = 0)")
    return out.where(F.length("record") > 0)


def _parsed(rows: DataFrame, schema: T.StructType, sep: str) -> DataFrame:
    """The records as columns."""
    value = F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), {"sep": sep, "quote": '"', "escape": '"'})
    return rows.withColumn("_value", value).select("file", "block", "seq", "_value.*")


def read_categories(spark: SparkSession, path: str, sep: str = SEP, multi_line: bool = True,
                    split: bool = False, line_sep: str = "\n") -> DataFrame:
    """The first column, whatever its name, as ``path``; ``cat_idx`` is
    the row position in the file (files in name order).

    With ``multi_line`` a file is one task; files without quoted line breaks
    are split like any text with ``multi_line=False``.  With ``split`` the records
    (ended by ``line_sep``) are read in byte ranges, quoted line breaks included."""
    if split:
        parsed = _parsed(records(spark, path, line_sep), T.StructType([T.StructField("path", T.StringType())]), sep)
        parsed = parsed.withColumn("path", _trim_line_ends(F.col("path"))).where(F.length("path") > 0)
        return with_row_index(parsed, ["file", "block", "seq"], "cat_idx").select("cat_idx", "path")
    raw = (spark.read.option("sep", sep).option("header", True).option("multiLine", multi_line)
           .option("escape", '"').csv(path))
    first = raw.columns[0]
    df = raw.select(_trim_line_ends(F.col(f"`{first}`")).alias("path"),
                    F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_mid"))
    df = df.where(F.col("path").isNotNull() & (F.length("path") > 0))
    return with_row_index(df, ["_file", "_mid"], "cat_idx").select("cat_idx", "path")


def read_products(spark: SparkSession, path: str, sep: str = SEP, line_sep: str | None = None,
                  multi_line: bool = True, split: bool = False) -> DataFrame:
    """The six product columns as strings, renamed (see ``PRODUCT_COLUMNS``).

    ``line_sep=None`` lets the parser detect the record end; pass ``'\\r'`` to
    force the reference's terminator.  With ``multi_line`` a file is one task, so
    its rows are dealt over the cluster at once; files without quoted line breaks
    are split like any text with ``multi_line=False``.  With ``split`` files are read in byte
    ranges, quoted line breaks included (``records``; ``line_sep`` is ``\\n`` if not given).
    """
    if split:
        parsed = _parsed(records(spark, path, line_sep or "\n"), PRODUCT_SCHEMA, sep)
        cols = [_trim_line_ends(F.col(src)).alias(dst) if dst == "uid" else F.col(src).alias(dst)
                for src, dst in PRODUCT_COLUMNS]
        return parsed.select(*cols).where(F.length("uid") > 0)
    r = (spark.read.schema(PRODUCT_SCHEMA).option("sep", sep).option("header", True)
         .option("multiLine", multi_line).option("escape", '"').option("quote", '"'))
    if line_sep:
        r = r.option("lineSep", line_sep)
    raw = r.csv(path)
    cols = [_trim_line_ends(F.col(src)).alias(dst) if dst == "uid" else F.col(src).alias(dst)
            for src, dst in PRODUCT_COLUMNS]
    df = raw.select(*cols).where(F.col("uid").isNotNull() & (F.length("uid") > 0))
    return df.repartition(spark.sparkContext.defaultParallelism) if multi_line else df


def text_as_products(spark: SparkSession, text: str, uid: str = "text-0") -> DataFrame:
    """One ad-hoc text as the only product (already a product text)."""
    return spark.createDataFrame([(uid, text)], "uid string, text string")
