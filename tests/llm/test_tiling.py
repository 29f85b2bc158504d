"""Greedy string tiling against the plain greedy search."""

import random

from llm_cases import LONG, ROWS, empty, odd, passage
from pyspark.sql import functions as F

from taxomatch.llm import queries
from taxomatch.llm import tiling as G

SF = "/root/testdata/sf0.001"


def brute(p, t, least):
    free_p, free_t, covered = [True] * len(p), [True] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while (i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n]
                       and free_p[i + n] and free_t[j + n]):
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return covered
        covered += n
        free_p[i : i + n] = free_t[j : j + n] = [False] * n


def test_tiles_against_plain_greedy():
    r = random.Random(2)
    for _ in range(600):
        p = [r.randrange(3) for _ in range(r.randrange(1, 25))]
        t = [r.randrange(3) for _ in range(r.randrange(1, 40))]
        tiles = G.tile(p, t, 3)
        assert all(n >= 3 and p[i : i + n] == t[j : j + n] for n, i, j in tiles)
        for side in (1, 2):
            own = [x for tile in tiles for x in range(tile[side], tile[side] + tile[0])]
            assert len(own) == len(set(own))
        assert sum(n for n, _, _ in tiles) == brute(p, t, 3)


ITEMS = [(1, passage(50, 40)), (2, passage(51, 18)), (3, "too short"), (4, None), (5, passage(52, 300)), (1, passage(50, 40))]


def planted():
    one, two, five = (dict(ITEMS)[i].split() for i in (1, 2, 5))
    lead, tail = passage(60, 50), passage(61, 70)
    return {
        100: (f"{lead} {' '.join(one)} {tail}", {1}),
        101: (f"{' '.join(one[20:])} {lead} {' '.join(one[:20])}", {1}),  # reordered
        102: (f"{lead}\n{', '.join(two).upper()}! {tail}", {2}),  # case and punctuation
        103: (f"{lead} {' '.join(one[:20])} {tail}", set()),  # half of it
        104: (f"{' '.join(five[150:])} {lead} {' '.join(five[:150])} x {' '.join(two)}", {2, 5}),
        105: (" ".join(w for i, w in enumerate(one) if i % 4), set()),  # no run of five words
        106: (f"too short {lead}", set()),
        107: (LONG + " " + " ".join(one), {1}),
        108: (" ".join(one[:17] + ["x"] + one[18:]), {1}),  # one word changed
    }


def test_leaks_and_clean_rows(spark, monkeypatch):
    items = spark.createDataFrame([(*x, "c") for x in ITEMS], "item_id long, text string, doc_id string")
    cases = planted()
    rows = [(i, t) for i, (t, _) in cases.items()] + ROWS
    want = {(i, k) for i, (_, own) in cases.items() for k in own}
    for bound in (G.SLICE, 300):  # one slice and several
        monkeypatch.setattr(G, "SLICE", bound)
        got = G.leaks(odd(spark, rows), items).collect()
        assert len(got) == len(want) and {(r.doc_id, r.item_id) for r in got} == want
        assert all(r.coverage >= 0.8 for r in got)
        df = odd(spark, rows)
        clean = G.without_leaks(df, items)
        assert clean.columns == df.columns
        assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(
            i or 0 for i, _ in rows if not any(i == d for d, _ in want))
    assert G.leaks(empty(spark), items).count() == 0
    assert G.leaks(odd(spark), items.limit(0)).count() == 0
    assert G.without_leaks(odd(spark), items.limit(0)).count() == len(ROWS)


def test_query_finds_whole_passages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in queries.op7_string_tiling(spark, SF).collect()}
    words = {i.item_id: G.tokens(i.text) for i in items}
    for d in docs:
        own = G.tokens(d.text)
        for i, w in words.items():
            covered = brute_cover(w, own)
            assert ((d.doc_id, i) in got) == (covered >= 0.8 * len(w)), (d.doc_id, i)
    assert got


def brute_cover(p, t):
    """Tiled words, by the plain greedy search where a run of five words is shared."""
    seeds = {tuple(t[j : j + 5]) for j in range(len(t) - 4)}
    if not any(tuple(p[i : i + 5]) in seeds for i in range(len(p) - 4)):
        return 0
    return brute(p, t, 5)


def test_broadcast_is_bounded(spark):
    items = spark.range(200).select(F.col("id").alias("item_id"), F.concat_ws(" ", *[F.sha2(F.concat(
        F.col("id").cast("string"), F.lit(str(k))), 256) for k in range(8)]).alias("text"))
    old, G.SLICE = G.SLICE, 20_000
    try:
        parts = list(G.slices(items))
    finally:
        G.SLICE = old
    assert len(parts) > 4 and sum(len(p.items) for p in parts) == 200
