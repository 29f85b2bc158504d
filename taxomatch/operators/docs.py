"""Documents of both sides and their ids.

category_docs : id, source, cat_idx, path, level, cat_type ('ALL'|'LAST'), text, doc_ord
product_docs  : uid, prod_idx, id, source, text
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxomatch.functions import text as TX
from taxomatch.operators.rows import placed, with_row_index

CATEGORY_SOURCE = "categories.csv"
PRODUCT_SOURCE = "products.csv"


def category_documents(categories: DataFrame, source: str = CATEGORY_SOURCE,
                       double_dash: str = TX.PATH_DOUBLE_DASH_TEXT, leaf: str = "text") -> DataFrame:
    """Two documents per category.

    ALL = the rewritten path (T1); LAST = the part after the last `` for `` of
    the rewritten path (T4), or with ``leaf='path'`` the rewritten last path
    part.  ``categories`` has ``cat_idx`` (position) and ``path``.

    The ids follow the run rule of ``run_counter`` (source:index:level:n):
    both documents of a category share the key and are neighbours, so ALL
    gets n=0 and LAST n=1; this is written directly instead of running the
    generic counter.
    """
    all_text = TX.path_text(F.col("path"), double_dash)
    if leaf == "path":
        last = TX.path_text(TX.path_leaf(F.col("path")), double_dash)
    else:
        last = TX.last_text(all_text)
    docs = categories.select(
        F.col("cat_idx").cast("long").alias("cat_idx"), "path",
        TX.path_level(F.col("path")).alias("level"),
        F.explode(F.array(
            F.struct(F.lit("ALL").alias("cat_type"), F.lit(0).alias("n"), all_text.alias("text")),
            F.struct(F.lit("LAST").alias("cat_type"), F.lit(1).alias("n"), last.alias("text")),
        )).alias("d"))
    return docs.select(
        F.concat_ws(":", F.lit(source), F.col("cat_idx").cast("string"), F.col("level").cast("string"),
                    F.col("d.n").cast("string")).alias("id"),
        F.lit(source).alias("source"), "cat_idx", "path", "level", "d.cat_type", "d.text",
        (F.col("cat_idx") * 2 + F.col("d.n")).cast("long").alias("doc_ord"))


def product_documents(products: DataFrame, text_col: str = "text", source: str = PRODUCT_SOURCE,
                      order: str = "uid") -> DataFrame:
    """One document per product.

    The id is ``uid:hash(text)`` so that an edited text is a new document
    (the reference's file+position key would reuse a stale vector).
    ``prod_idx`` is the position in ``order`` (G1).
    """
    docs = products.select("uid", F.col(text_col).alias("text"))
    docs = with_row_index(docs, [order], "prod_idx")
    return docs.select(
        "uid", "prod_idx",
        F.concat_ws(":", F.col("uid"), F.lower(F.hex(F.xxhash64("text")))).alias("id"),
        F.lit(source).alias("source"), "text")


def simple_ids(df: DataFrame, source: str, idx: str = "idx") -> DataFrame:
    """G4, simple form: file name + position."""
    return df.withColumn("id", F.concat(F.lit(source), F.col(idx).cast("string")))


def run_counter(df: DataFrame, key: str, pos: str = "idx", name: str = "n") -> DataFrame:
    """``n`` = 0 for the first row of each run of equal ``key`` in
    ``pos`` order, then 1, 2, ...; a key that comes back later starts at 0.

    ``pos`` is a position (unique, see ``with_row_index``).  No window is
    partitioned by ``key`` (a hot key would land in one task): rows are placed
    in ranges of ``pos`` and written once, the previous row is a ``lag`` inside
    the range plus the last row of the range before, and the start of the
    current run is a running maximum inside the range plus a carry over the
    ranges (one row each).
    """
    r = placed(df, [F.col(pos)])
    inside = Window.partitionBy("_pid").orderBy("_local")
    ranges = Window.orderBy("_pid")
    row = F.struct(F.col(key).alias("key"))
    edges = r.groupBy("_pid").agg(F.max_by(row, "_local").alias("_last"))
    edges = edges.select("_pid", F.lag("_last").over(ranges).alias("_before"))
    s = r.withColumn("_prev", F.lag(row).over(inside)).join(F.broadcast(edges), "_pid")
    s = s.withColumn("_prev", F.when(F.col("_local") == 0, F.col("_before")).otherwise(F.col("_prev")))
    s = s.withColumn("_start", F.when(
        F.col("_prev").isNull() | ~F.col("_prev.key").eqNullSafe(F.col(key)), F.col(pos)))
    carry = (s.groupBy("_pid").agg(F.max("_start").alias("_pmax"))
             .select("_pid", F.max("_pmax").over(
                 ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry")))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = s.withColumn("_run", F.max("_start").over(running)).join(F.broadcast(carry), "_pid")
    return out.withColumn(name, (F.col(pos) - F.coalesce("_run", "_carry")).cast("long")).drop(
        "_pid", "_local", "_prev", "_before", "_start", "_run", "_carry")


def chunk_ids(df: DataFrame, source: str, index: str, level: str | None, pos: str = "idx") -> DataFrame:
    """``source:index:level:n`` with ``n`` from ``run_counter`` over the key
    ``source:index:level`` in ``pos`` order."""
    parts = [F.lit(source), F.col(index).cast("string")]
    parts.append(F.col(level).cast("string") if level else F.lit("None"))
    keyed = df.withColumn("_key", F.concat_ws(":", *parts))
    out = run_counter(keyed, "_key", pos, "_n")
    return out.withColumn("id", F.concat_ws(":", F.col("_key"), F.col("_n").cast("string"))).drop("_key", "_n")
