"""Text functions on the hand-made rows of FIXTURES.md §2."""

from pyspark.sql import functions as F

from taxomatch.functions import text as TX
from taxomatch.operators import docs as D

CATS = [
    ("facilities/gym/machines", "facilities for gym for machines", "machines", 3),
    ("kitchen/pots--pans", "kitchen for pots to pans", "pots to pans", 2),
    ("office/desk-lamps", "office for desk lamps", "desk lamps", 2),
    ("shop/tools-for-wood", "shop for tools for wood", "wood", 2),
    ("single", "single", "single", 1),
]

PRODS = [
    ("p1", "Steel pan, 28 cm", "['Pans','Cookware']", "Steel pan categorize as Pans or Cookware"),
    ("p2", "XL, Towel, white", "Linen", "XL  Towel categorize as Linen"),
    ("p3", "Desk lamp", None, "Desk lamp"),
    ("p4", "Desk lamp", "[]", "Desk lamp"),
    ("p5", "Bolt", "Joe's parts", "Bolt categorize as Joe's parts"),
    ("p6", None, "Linen", " categorize as Linen"),
    ("p7", "Nut", "[None,'A']", "Nut"),
]


def test_category_documents(spark):
    cats = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CATS)], "cat_idx long, path string")
    docs = {(r.path, r.cat_type): r for r in D.category_documents(cats).collect()}
    for i, (path, all_text, last, level) in enumerate(CATS):
        a, lst = docs[(path, "ALL")], docs[(path, "LAST")]
        assert a.text == all_text
        assert lst.text == last
        assert a.level == level == lst.level
        assert a.id == f"categories.csv:{i}:{level}:0"
        assert lst.id == f"categories.csv:{i}:{level}:1"
        assert (a.doc_ord, lst.doc_ord) == (2 * i, 2 * i + 1)


def test_leaf_option(spark):
    cats = spark.createDataFrame([(0, "shop/tools-for-wood")], "cat_idx long, path string")
    r = D.category_documents(cats, leaf="path").where("cat_type = 'LAST'").first()
    assert r.text == "tools for wood"


def test_product_text(spark):
    df = spark.createDataFrame([(p[0], p[1], p[2]) for p in PRODS], "uid string, title string, vc string")
    got = {r.uid: r.text for r in df.select("uid", TX.product_text("title", "vc").alias("text")).collect()}
    assert got == {p[0]: p[3] for p in PRODS}


def test_product_text_plain_and_legacy_nan(spark):
    df = spark.createDataFrame([("p1", "Steel pan, 28 cm", "['Pans','Cookware']"), ("p6", None, "Linen")],
                               "uid string, title string, vc string")
    plain = {r.uid: r.t for r in df.select("uid", TX.product_text("title", "vc", joiner=" ").alias("t")).collect()}
    assert plain["p1"] == "Steel pan Pans or Cookware"
    legacy = {r.uid: r.t for r in df.select("uid", TX.product_text("title", "vc", legacy_nan=True).alias("t")).collect()}
    assert legacy["p6"] == "nan categorize as Linen"


def test_vendor_labels(spark):
    rows = [("a", "['A', 'B']"), ("b", "plain"), ("c", None), ("d", "nan"), ("e", "None"), ("f", "[]"),
            ("g", "[None,'A']"), ("h", "[broken"), ("i", "['NoneSuch']")]
    df = spark.createDataFrame(rows, "k string, v string")
    got = {r.k: r.l for r in df.select("k", TX.vendor_labels("v").alias("l")).collect()}
    assert got["a"] == ["A", "B"]
    assert got["b"] == ["plain"]
    assert got["c"] == [] and got["d"] == [] and got["e"] == [] and got["f"] == []
    assert got["g"] == [None, "A"]
    assert got["h"] == ["[broken"]
    assert got["i"] == ["NoneSuch"]


def test_clean_text(spark):
    df = spark.createDataFrame([("The 2 RED pans, don't burn!", "kitchen/pots--pans"), (None, "a")],
                               "t string, p string")
    r = df.select(TX.clean_text("t").alias("c"), TX.clean_text("p", cat=True).alias("cp")).collect()
    assert r[0].c == "red pans burn"
    assert r[0].cp == "kitchen pots pans"
    assert r[1].c == ""


def test_clean_words_whitespace_and_accents(spark):
    df = spark.createDataFrame([("café\tbar\x0bbaz qux  ",)], "t string")
    assert df.select(TX.clean_words("t").alias("w")).first().w == ["caf", "bar", "baz", "qux"]


def test_type_extract(spark):
    df = spark.createDataFrame([("pots type: steel for x type: iron for y",), ("nothing here",)], "t string")
    r = df.select(TX.extract_all("t").alias("a"), TX.extract_first("t").alias("f")).collect()
    assert (r[0].a, r[0].f) == ("steel  iron", "steel")
    assert (r[1].a, r[1].f) == ("", None)


def test_type_path_variant(spark):
    df = spark.createDataFrame([("kitchen/pots--pans",)], "p string")
    assert df.select(TX.path_text("p", TX.TYPE_DOUBLE_DASH_TEXT).alias("t")).first().t == \
        "kitchen for pots type: pans"


def test_chunk_words(spark):
    df = spark.createDataFrame([(list("abcdefg"),), ([],)], "w array<string>")
    r = df.select(TX.chunk_words(F.col("w"), 3).alias("c")).collect()
    assert r[0].c == [["a", "b", "c"], ["d", "e", "f"], ["g"]]
    assert r[1].c == []


def test_word_texts(spark):
    df = spark.createDataFrame([("T", "D", "['None','X']"), (None, None, None)], "t string, d string, v string")
    r = df.select(TX.product_word_text("t", "v").alias("w"), TX.corpus_text("t", "d", "v").alias("c")).collect()
    assert r[0].w == "T ['','x']"
    assert r[0].c == "T D ['None','X']"
    assert r[1].w == "nan " and r[1].c == "nan nan nan"


def test_stop_words_are_sparks_list():
    w = TX.stop_words()
    assert len(w) == 181
    for x in ("s", "t", "don", "to", "for"):
        assert x in w
