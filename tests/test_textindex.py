"""Substring search by character runs: rows of the full scan, files skipped."""

from pyspark.sql import functions as F

from taxomatch.sources import collections as S
from taxomatch.sources.textindex import TextIndex


def _embed(df):
    return df.withColumn("vec", F.array(F.length("text").cast("double"), F.lit(1.0)))


def _key(df):
    return sorted((r.id, r.text, tuple(r.vec)) for r in df.collect())


def test_equal_to_the_full_scan_with_files_skipped(spark, scratch):
    rows = [(f"d{i}", f"row {i} " + "common words " * (i % 5)) for i in range(300)]
    rows += [("rare", "a zyzzyva \U0001f600\U0001f600\U0001f600\u00e9\u00e9 here"), ("none", None), ("empty", ""), ("short", "abc")]
    docs = spark.createDataFrame(rows, "id string, text string")
    store = S.VectorStore(spark, scratch)
    store.add_missing(docs, S.PRODUCTS, {"m": _embed})
    index = TextIndex(store, S.PRODUCTS, "m")
    every = index.files()
    assert index.candidates("zyzzyva") == every                  # no index yet
    assert index.update() == len(every) and index.update() == 0
    for needle in ("zyzzyva", "\U0001f600\u00e9\u00e9", "\U0001f600\U0001f600\U0001f600\u00e9", "row 7", "abc", "",
                   "row 123 common words common words common"):
        assert _key(index.find(needle, True)) == _key(store.find_text(S.PRODUCTS, "m", needle, True)), needle
    assert len(index.candidates("zyzzyva")) == 1 and len(every) > 20
    assert index.find("zyzzyva").columns == store.find_text(S.PRODUCTS, "m", "zyzzyva").columns


def test_later_files_are_read_until_indexed(spark, scratch):
    docs = spark.createDataFrame([(f"d{i}", f"text number {i}") for i in range(100)], "id string, text string")
    store = S.VectorStore(spark, scratch)
    index = TextIndex(store, S.PRODUCTS, "m")
    assert index.files() == [] and index.update() == 0
    store.add_missing(docs.limit(50), S.PRODUCTS, {"m": _embed})
    index.update()
    before = set(index.files())
    late = spark.createDataFrame([("late", "a zyzzyva")], "id string, text string")
    store.add_missing(late, S.PRODUCTS, {"m": _embed})
    assert [r.id for r in index.find("zyzzyva").collect()] == ["late"]
    assert not set(index.candidates("zyzzyva")) & before and index.update() == 1
    store.drop(S.PRODUCTS, "m")
    store.add_missing(docs.limit(3), S.PRODUCTS, {"m": _embed})
    assert index.find("zyzzyva").count() == 0 and index.find("number").count() == 3


def test_a_file_is_one_bitmap_of_a_task(spark, scratch):
    """The texts become bits where they are read; what is shuffled are pieces of bitmaps."""
    import numpy as np
    import pyarrow as pa

    from taxomatch.sources import textindex as TI

    text = "a zyzzyva \U0001f600\u00e9 here"
    bits = TI.gram_bits(text)
    assert len(bits) == len(text) - 3 and 0 <= bits.min() <= bits.max() < TI.BITS
    assert set(TI.gram_bits(text[3:12]).tolist()) <= set(bits.tolist()) and len(TI.gram_bits("abc")) == 0
    batch = lambda *rows: pa.RecordBatch.from_pylist([{"file": f, "text": t} for f, t in rows])
    out = list(TI._file_pieces(iter([batch(("f", "x"), ("f", text)), batch(("f", text), ("g", None))])))
    assert [set(o["file"].to_pylist()) for o in out] == [{"f"}, {"g"}]
    found = {p * TI.PIECE + i for p, b in zip(out[0]["piece"].to_pylist(), out[0]["bits"].to_pylist()) if p >= 0
             for i in np.nonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little"))[0].tolist()}
    assert found == set(bits.tolist()) and out[1]["piece"].to_pylist() == [-1]
