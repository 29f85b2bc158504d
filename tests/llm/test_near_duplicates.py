"""MinHash forest and components against all pairs."""

import random

import pytest
from llm_cases import CLASHES, ROWS, empty, odd

from taxomatch.llm import minhash as M
from taxomatch.llm.components import components

SF = "/root/testdata/sf0.001"
RULES = (M.Rule(3, 85, 100), M.Rule(5, 80, 100))


def sets_of(rows, words):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(len(w), words)
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    return out


def brute(rows, rule):
    sets = sets_of(rows, rule.words)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and rule.linked(len(a & b), len(a | b)):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def families(seed, groups=12, size=14, words=60):
    """Texts and copies with a few words replaced, some near the threshold."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randrange(4)):
                t[r.randrange(words)] = r.choice(vocabulary)
            rows.append(t)
            if r.random() < 0.3:
                base = t  # chains: the ends need not be linked directly
    r.shuffle(rows)
    return [(100 + i, " ".join(t)) for i, t in enumerate(rows)]


def result(df, rule):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df, rule).collect()}


@pytest.mark.parametrize("rule", RULES)
def test_against_all_pairs(spark, rule):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(100_000 + i, t) for i, t in docs] + families(1) + [x for x in ROWS if x[0] not in (None, 10)]
    want = brute(rows, rule)
    assert sum(not k for _, _, k in want.values()) > 60
    assert result(odd(spark, rows), rule) == want


def test_crowded_regions_are_deepened_and_cut(spark, monkeypatch):
    """With tiny regions all depths and the cut by hash are used."""
    monkeypatch.setattr(M, "REGION", 6)
    rows = families(2, groups=3, size=30)
    rows += [(5000 + i, rows[0][1] + f" x{i}") for i in range(40)]  # one crowd of near copies
    assert result(odd(spark, rows), RULES[0]) == brute(rows, RULES[0])


def star(seed, copies, words=200):
    """A template and copies, each linked to it but not to each other."""
    r = random.Random(seed)
    base = [f"t{i}" for i in range(words)]
    rows = [(copies // 2, " ".join(base))]
    for c in range(copies + 1):
        if c != copies // 2:
            t = list(base)
            for at in r.sample(range(words // 4), 5):
                t[4 * at + 1] = f"c{c}-{at}"
            rows.append((c, " ".join(t)))
    return rows


@pytest.mark.parametrize("hubs", (True, False))
def test_copies_of_a_template_that_are_not_near_each_other(spark, monkeypatch, hubs):
    """Every copy meets its template in a crowd, by the hubs and by the blocks alone."""
    monkeypatch.setattr(M, "REGION", 24)
    if not hubs:
        monkeypatch.setattr(M, "_hubs", lambda crowds: crowds.select("key", "node").limit(0))
    rows = star(4, 700)
    sets = sets_of(rows, 3)
    linked = lambda a, b: RULES[0].linked(len(sets[a] & sets[b]), len(sets[a] | sets[b]))
    assert all(linked(350, i) for i in sets) and sum(linked(9, i) for i in sets) < 9
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), RULES[0]).collect()
    assert [r.doc_id for r in got if r.component_id != 0] == []


def test_odd_rows(spark):
    got = M.near_duplicates(odd(spark), RULES[0]).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i in (1, 2, 3):
        assert (by[i].n_shingles, by[i].component_id, by[i].kept) == (0, i, True)
    assert (by[4].n_shingles, by[7].component_id, by[7].kept, by[14].component_id) == (1, 6, False, 13)
    assert [r.component_id for r in got if r.doc_id == 10] == [10, 10]
    assert sorted((r.component_id or 0, r.kept) for r in got if r.doc_id is None) == [(0, False), (6, False)]
    assert M.near_duplicates(empty(spark), RULES[0]).count() == 0


def test_one_of_each(spark):
    rows = [*ROWS, *families(3, groups=4, size=6)]
    df = odd(spark, rows)
    kept = M.one_of_each(df, RULES[1])
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    want = brute([x for x in rows if x[0] not in (None, 10)], RULES[1])
    assert sorted(i for i, _ in got if i not in (None, 10)) == sorted(i for i, (_, _, k) in want.items() if k)
    assert [t for i, t in got if i == 10] == [dict(ROWS)[10]]  # of a repeated row, one stays
    assert [t for i, t in got if i is None] == [ROWS[11][1]]  # the copy of text 6 without id goes
    assert M.one_of_each(empty(spark), RULES[1]).count() == 0
    assert set(CLASHES) <= set(kept.columns)


def test_near_texts_without_ids(spark):
    words = [f"n{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join([*words, "other"])]
    df = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (7, texts[2])], "doc_id long, text string")
    got = M.near_duplicates(df, RULES[0]).collect()
    assert sorted((r.component_id, r.kept) for r in got) == [(7, False), (7, False), (7, True)]
    assert [r.doc_id for r in M.one_of_each(df, RULES[1]).collect()] == [7]


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 50)]
    edges += [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(None, 3), (7, 7), (2, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_intersections_of_small_and_large_groups():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (2, 24, 25, 60):
        sets = [np.unique(r.integers(0, 9000, r.integers(0, 6000)).astype(np.uint64)) for _ in range(n)]
        got = M.intersections(sets)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(n) if i != j)
