"""Suffix and window dedup against brute force; the merge of runs."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ROWS, empty, odd, passage

from taxomatch.llm import substring_dedup as W
from taxomatch.llm import suffix_anchors as A
from taxomatch.llm import suffix_dedup as S
from taxomatch.llm import suffix_merge as G

SF = "/root/testdata/sf0.001"


def sha(b):
    return hashlib.sha256(b).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=5), max_size=8), max_size=9))
def test_merge_of_front_coded_runs(lists):
    runs = [sorted((b"\x01" * 150 + x).ljust(A.WINDOW, b"\0") for x in own) for own in lists]
    coded = [G.expand(*G.front_code(r)) for r in runs]
    assert [s for s, _ in coded] == runs
    order, shared = G.merge(coded)
    merged = [runs[i][j] for i, j in order]
    assert merged == sorted(x for r in runs for x in r) and len(set(order)) == len(order)
    assert shared[1:] == [G.shared_prefix(a, b) for a, b in zip(merged, merged[1:])]


def test_merge_never_reads_a_known_prefix():
    """Byte comparisons start behind what both suffixes share with the last winner."""
    read = []
    real = G.shared_prefix
    try:
        G.shared_prefix = lambda a, b, start=0: (read.append(start), real(a, b, start))[1]
        runs = [sorted(b"\x07" * 180 + bytes([i, j]).ljust(20, b"\0") for j in range(9)) for i in range(8)]
        G.merge([G.expand(*G.front_code(r)) for r in runs])
    finally:
        G.shared_prefix = real
    merging = read[len([1 for r in runs for _ in r[1:]]):]
    assert merging and sum(s == 0 for s in merging) <= 7  # only the first round starts at 0


def test_chunks_cover_every_window_and_follow_the_bytes():
    r = random.Random(1)
    shared = bytes(r.choice(b"abc ") for _ in range(900))
    texts = [bytes(r.choice(b"abc ") for _ in range(n)) + shared + b"z" * n for n in (0, 1, 37, 400)]
    texts += [b"ab" * 700, b"\0" * 500, b"x" * 199, b"y" * 200, b""]
    offsets = {}
    for t in texts:
        at, first, last, _ = A.chunks(t)
        assert [x for a, b in zip(first, last) for x in range(a, b + 1)] == list(range(max(0, len(t) - A.WINDOW + 1)))
        for a, lo, hi in zip(at.tolist(), first.tolist(), last.tolist()):
            for s in range(lo, hi + 1):
                assert s <= a <= s + A.WINDOW - A.GRAM
                assert offsets.setdefault(t[s : s + A.WINDOW], a - s) == a - s


def test_segments_of_long_texts(monkeypatch):
    text = "".join(random.Random(2).choice("ab") for _ in range(9000)).encode()
    whole = A.chunks(text)
    monkeypatch.setattr(A, "SEGMENT", 1 << 10)
    parts = A.chunks(text)
    windows = lambda c: {s: a for a, lo, hi in zip(*(x.tolist() for x in c[:3])) for s in range(lo, hi + 1)}
    assert windows(whole) == windows(parts)


def brute_bytes(texts):
    count = {}
    for t in texts:
        for k in range(len(t) - 199):
            g = t[k : k + 200]
            count[g] = count.get(g, 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, sha(kept), kept))
    return out


def mosaics(seed, n=60):
    """Texts of shared passages with different neighbours, cut at all places."""
    r = random.Random(seed)
    parts = [passage(100 + i, 60) for i in range(6)]
    rows = []
    for i in range(n):
        text = passage(1000 + i, r.randrange(40))
        for _ in range(r.randrange(4)):
            p = r.choice(parts)
            a, b = sorted((r.randrange(len(p)), r.randrange(len(p))))
            text += p[a:b] + passage(5000 + r.randrange(10**6), r.randrange(12))
        rows.append((50 + i, text))
    return rows + [(900, "é" * 150), (901, "é" * 151), (902, "ab " * 300), (903, "\0" * 450), (904, parts[0] * 3)]


@pytest.mark.parametrize(("bucket", "group"), [(S.BUCKET, S.GROUP), (20, S.GROUP), (20, 2)])
def test_bytes_against_brute_force(spark, bucket, group):
    docs = [(r.doc_id + 10_000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()
            if len(r.text) < 3000][:60]
    rows = mosaics(1) + docs + [x for x in ROWS if x[0] != 5]
    got = S.dedup_bytes(odd(spark, rows), kept=True, bucket=bucket, group=group).collect()
    want = brute_bytes([(t or "").encode() for _, t in rows])
    key = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept_bytes)) for r in got),
                  key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)
    assert sum(0 < w[1] < w[0] for w in want) > 20


def brute_words(rows):
    low = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            if i is not None:
                low[g] = min(low.get(g, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and low[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), sha(kept), kept.decode()))
    return out


def test_cover_has_every_difference():
    assert {(a - b) % W.PERIOD for a in W.COVER for b in W.COVER} == set(range(W.PERIOD))


def test_words_against_brute_force(spark):
    r = random.Random(9)
    long = passage(77, 400).split()
    rows = []
    for i in range(60):
        a = r.randrange(len(long))
        words = passage(200 + i, r.randrange(60)).split() + long[a : a + r.randrange(40, 140)]
        rows.append((300 - i, r.choice([" ", "\n", "  \t"]).join(words + passage(900 + i, 5).split())))
    rows += [*ROWS, (400, "a " * 200), (401, "a " * 120), (5, passage(1)), (402, " ".join(long))]
    got = W.dedup_windows(odd(spark, rows), texts=True).collect()
    want = brute_words(rows)
    key = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256, x.kept_text) for x in got), key=key) == sorted(
        want, key=key)
    assert sum(0 < w[2] < w[1] for w in want) > 20


def test_empty_tables(spark):
    assert S.dedup_bytes(empty(spark)).count() == 0
    assert W.dedup_windows(empty(spark)).count() == 0
