"""Shards by longest processing time: the dealing of size classes, the operator against brute force and SQL."""

import heapq
import zlib
from collections import defaultdict

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import odd

from taxomatch.llm import sharding as S


def one_by_one(sizes, shards):
    heap, out = [(0, j) for j in range(shards)], []
    for s in sizes:
        load, j = heap[0]
        heapq.heapreplace(heap, (load + s, j))
        out.append(j)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([1, 2, 3, 5, 8, 40, 1000]), st.integers(1, 60)), max_size=80), st.integers(1, 7))
def test_size_classes_are_dealt_like_single_groups(sizes, shards):
    sizes.sort(reverse=True)
    heap, got = [(0, j) for j in range(shards)], []
    for s in dict.fromkeys(sizes):
        for given_, cycle in S.deal(heap, s, sizes.count(s)):
            got += [cycle[k % len(cycle)] for k in range(given_)]
    assert got == one_by_one(sizes, shards)


def test_a_huge_class_is_a_few_turns():
    heap = [(0, 0), (10**9, 1), (10**9 + 5, 2)]
    assert len(S.deal(heap, 1, 10**12)) < 6
    assert max(heap)[0] - min(heap)[0] <= 1


def _brute(rows, shards):
    import hashlib

    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    order = sorted(groups, key=lambda t: (-(len(t.encode()) + 1) * len(groups[t]), hashlib.sha256(t.encode()).digest()))
    dealt = one_by_one([(len(t.encode()) + 1) * len(groups[t]) for t in order], shards)
    slots, out = defaultdict(int), []
    for t, j in zip(order, dealt):
        for i in sorted(groups[t], key=lambda i: (i is not None, i or 0)):
            out.append((i, len(t.encode()) + 1, zlib.crc32(t.encode()), j, slots[j]))
            slots[j] += 1
    return sorted(out, key=str)


def test_operator_and_sql(spark, monkeypatch):
    df = odd(spark).unionByName(odd(spark, [(100 + i, "copy " * 9) for i in range(400)] + [(600 + i, f"t{i % 90}") for i in range(300)]))
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = _brute(rows, 5)
    assert sorted(map(tuple, S.shard_documents(df, 5).collect()), key=str) == want
    monkeypatch.setattr(S, "BROADCAST_CLASSES", 0)
    assert sorted(map(tuple, S.shard_documents(df, 5).collect()), key=str) == want
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    sql = con.sql(f"SELECT doc_id, size, text_crc32, shard, slot FROM ({S.oracle(5)})").fetchall()
    assert sorted(sql, key=str) == want
    assert S.shard_documents(df.limit(0)).count() == 0
