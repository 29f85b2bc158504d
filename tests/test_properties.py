"""Property tests: the Spark column rules against plain Python versions of the
same written rules, on random strings."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from taxomatch.functions import text as TX
from taxomatch.operators import docs as D

ALPHABET = st.sampled_from(list("abcXYZ  ,;/-'!9éÉ\t\nß") + ["--", " for ", "None", "[", "]"])
TEXTS = st.lists(ALPHABET, max_size=25).map("".join)


def py_clean(text: str | None) -> str:
    """The cleaning rule as written in the survey: lower, non-letters to space,
    squeeze whitespace, strip, drop stop words."""
    if text is None:
        return ""
    t = text.lower()
    t = re.sub(r"[^a-zA-Z \t\n\x0b\f\r]", " ", t)
    t = re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ")
    stop = set(TX.stop_words())
    return " ".join(w for w in t.split(" ") if w and w not in stop)


def py_head(title: str | None) -> str:
    parts = ("" if title is None else title).split(",")
    return " ".join(parts[:2]) if len(parts[0]) <= 2 else parts[0]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), TEXTS), min_size=1, max_size=40))
def test_clean_text_matches_rule(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", TX.clean_text("t").alias("c")).collect()}
    assert got == {i: py_clean(t) for i, t in enumerate(texts)}


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), TEXTS), min_size=1, max_size=40))
def test_title_head_and_paths(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", TX.title_head("t").alias("h"), TX.path_text("t").alias("p"),
                     TX.last_text(TX.path_text("t")).alias("l")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.h == py_head(t)
        if t is not None:
            p = t.replace("--", " to ").replace("-", " ").replace("/", " for ")
            assert r.p == p
            assert r.l == p.split(" for ")[-1]


def test_edited_text_gets_new_id(spark):
    a = spark.createDataFrame([("u1", "red pan")], "uid string, text string")
    b = spark.createDataFrame([("u1", "red pan, large")], "uid string, text string")
    ia = D.product_documents(a).first().id
    ib = D.product_documents(b).first().id
    assert ia != ib and ia.startswith("u1:") and ib.startswith("u1:")
