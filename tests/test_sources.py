"""CSV readers, answer sink, word vector files."""

import json
import os

import pytest

from taxomatch.sources import answers as A
from taxomatch.sources import csv as CSV
from taxomatch.sources import wordvec as WV

HEADER = "uniqueIdentifier;metaTitle;metaDescription;metaSpecs;vendorCategory;vendor"


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


def test_products_cr_records_with_quoted_breaks(spark, scratch):
    rows = [
        'p1;"Pan, steel";"line one\nline two";;"[\'Pans\',\'Cookware\']";ACME',
        'p2;"A;B";"has \r inside";;Linen;V',
        "p3;Nut;;;;",
    ]
    path = f"{scratch}/cr/products.csv"
    _write(path, "\r".join([HEADER] + rows) + "\r")
    df = CSV.read_products(spark, path, line_sep="\r")
    got = {r.uid: r for r in df.collect()}
    assert set(got) == {"p1", "p2", "p3"}
    assert got["p1"].title == "Pan, steel" and got["p1"].description == "line one\nline two"
    assert got["p2"].title == "A;B" and got["p2"].description == "has \r inside"
    assert got["p1"].vendor_category == "['Pans','Cookware']"


def test_products_crlf_file(spark, scratch):
    path = f"{scratch}/crlf/products.csv"
    _write(path, "\r\n".join([HEADER, "p1;T1;;;;", "p2;T2;;;;"]) + "\r\n")
    got = sorted((r.uid, r.title) for r in CSV.read_products(spark, path).collect())
    assert got == [("p1", "T1"), ("p2", "T2")]


def test_categories_first_column_and_position(spark, scratch):
    path = f"{scratch}/cats/categories.csv"
    _write(path, "whatever;other\nb/x;1\na/y;2\nc;3\n")
    got = [(r.cat_idx, r.path) for r in CSV.read_categories(spark, path).orderBy("cat_idx").collect()]
    assert got == [(0, "b/x"), (1, "a/y"), (2, "c")]


def test_text_as_products(spark):
    assert CSV.text_as_products(spark, "hello", "x").first().asDict() == {"uid": "x", "text": "hello"}


def test_answers_roundtrip(spark, scratch):
    ans = spark.createDataFrame([("1", "a/b"), ("2", "c")], "_id string, category string")
    A.write_answers(ans, f"{scratch}/answers")
    assert sorted(A.read_answers(spark, f"{scratch}/answers").collect()) == sorted(ans.collect())
    arr = json.loads(A.answers_as_array(ans, 100).first().json)
    assert arr == [{"_id": "1", "category": "a/b"}, {"_id": "2", "category": "c"}]


def test_answers_as_parts(spark, monkeypatch):
    rows = [(f"{i:02d}", f"a/{i}\"") for i in range(25)]
    ans = spark.createDataFrame(rows, "_id string, category string").repartition(3)
    for n in (1, 10, 25, 100):
        parts = sorted(A.answers_as_parts(ans, n).collect())
        assert [p.part for p in parts] == list(range(-(-25 // n)))
        assert [(x["_id"], x["category"]) for x in json.loads("".join(p.json for p in parts))] == rows
    assert [tuple(p) for p in A.answers_as_parts(ans.limit(0)).collect()] == [(0, "[]")]
    monkeypatch.setattr(A, "MAX_ARRAY_ROWS", 20)
    with pytest.raises(ValueError):  # whatever the caller states
        A.answers_as_array(ans, 1000)


def test_word2vec_text_format(spark, scratch):
    path = f"{scratch}/wv/vectors.txt"
    _write(path, "2 3\nfoo 1 2 3\nbar 0.5 0 -1\n")
    got = {r.word: r.vec for r in WV.read_word2vec_text(spark, path).collect()}
    assert got == {"foo": [1.0, 2.0, 3.0], "bar": [0.5, 0.0, -1.0]}
    WV.save_word_vectors(WV.read_word2vec_text(spark, path), f"{scratch}/wv_table")
    assert WV.load_word_vectors(spark, f"{scratch}/wv_table").count() == 2


def test_answers_per_slice_files(spark, scratch):
    ans = spark.createDataFrame([(str(i), "c") for i in range(40)], "_id string, category string")
    A.write_answers(ans, f"{scratch}/sliced", slices=4)
    parts = [f for f in os.listdir(f"{scratch}/sliced") if f.startswith("part-")]
    assert len(parts) == 4
    assert A.read_answers(spark, f"{scratch}/sliced").count() == 40


def _quoted_rows(n):
    text = ['plain', 'a;b', 'line\none', '"said"', 'x\n\n"y;\nz"\n', '', 'é\r\nö']
    quote = lambda v: '"' + v.replace('"', '""') + '"' if set(v) & set(';"\n\r') else v
    rows = [(f"p{i}", text[i % 7] * (1 + i % 3), "w " * (i % 50) + text[i % 5]) for i in range(n)]
    rows[n // 2] = ("big", "long\nvalue " * 3000, "x")  # over many ranges
    return [";".join([u, quote(t), quote(x), "", "", "v"]) for u, t, x in rows]


@pytest.mark.parametrize("line_sep,end", [("\n", "\n"), ("\r", "")], ids=["lf", "cr"])
def test_split_reader_equals_multi_line(spark, scratch, line_sep, end):
    scratch = scratch.replace("[", "-").replace("]", "-")  # no glob
    rows = _quoted_rows(2000)
    if line_sep == "\r":
        rows = [r.replace("\r", "").replace("\n", "\r") if i % 3 else r.replace("\r", "") for i, r in enumerate(rows)]
    for i in range(2):
        _write(f"{scratch}/split/{i}.csv", line_sep.join([HEADER, *rows[i * 1000:(i + 1) * 1000]]) + end)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        pieces = CSV.records(spark, f"{scratch}/split", line_sep)
        assert pieces.select("file", "block").distinct().count() > 20  # many ranges, some without a start
        got = sorted(map(tuple, CSV.read_products(spark, f"{scratch}/split", line_sep=line_sep, split=True).collect()), key=str)
        paths = [(r.cat_idx, r.path) for r in CSV.read_categories(spark, f"{scratch}/split", split=True, line_sep=line_sep).orderBy("cat_idx").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    want = sorted(map(tuple, CSV.read_products(spark, f"{scratch}/split", line_sep=line_sep).collect()), key=str)
    assert len(want) == 2000 and got == want
    assert paths == [(i, r.split(";")[0]) for i, r in enumerate(rows)]
    assert CSV.records(spark, f"{scratch}/split", line_sep).count() == 2000


def test_split_reader_of_empty_and_open_files(spark, scratch):
    _write(f"{scratch}/odd/a.csv", "")
    _write(f"{scratch}/odd/b.csv", HEADER + "\n")
    _write(f"{scratch}/odd/c.csv", HEADER + '\n\np1;"never closed;;;;\nx')
    assert [r.record for r in CSV.records(spark, f"{scratch}/odd").collect()] == ['p1;"never closed;;;;\nx']


def test_word_vector_lines_are_counted_by_their_scan(spark, scratch):
    from taxomatch.sources import wordvec as WV
    lines = ["4 2", "red 1 2", "pan 1 x", "lid 3 4", "", "pot 1", "cup 1 2 3"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{scratch}/v")
    df, seen = WV.read_word2vec_counted(spark, f"{scratch}/v", 2)
    WV.save_word_vectors(df, f"{scratch}/t")
    assert seen.get == {"lines": 7, "words": 2, "headers": 1, "bad": 4}
    read = lambda t: sorted((r.word, r.vec) for r in t.collect())
    assert read(WV.load_word_vectors(spark, f"{scratch}/t")) == read(WV.read_word2vec_text(spark, f"{scratch}/v", 2))
