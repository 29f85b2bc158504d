"""Conversation trie against brute force and SQL, the spilling queue."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taxomatch.llm import prefix_trie as P
from taxomatch.llm.spill_queue import KEY, SpillQueue


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    total, out = {}, []
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(total[x][1] for x in kids[k])
        total[k] = (sum(total[x][0] for x in kids[k]) or 1, saved)
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), *total[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def _rows():
    r = random.Random(5)
    rows = []
    for c in [*range(0, 60), *range(103, 160, 3)]:  # some families without their first conversation
        for t in range(r.choice([1, 2, 6, 12])):
            rows.append((c, t if t else None, r.choice(["user", None]), r.choice(["hi", "é ß", None, "", "龍" * 3])))
    rows += [(200 + i, t, "user", "same") for i in range(40) for t in range(12)]  # copies
    rows += [(300, t, "user", str(t % 7)) for t in range(700)]  # a long one
    return [*rows, (None, 1, "user", "x"), (0, 50, "b", "tie"), (0, 50, "a", "tie"), (1, 3, "user", "again"), (1, 3, "user", "again")]


@pytest.fixture(scope="module")
def table():
    rows = _rows()
    return rows, brute(rows)


def _got(spark, rows, **kw):
    df = spark.createDataFrame([(*x, "c", 0) for x in rows], "conv_id long, turn long, role string, text string, node string, depth long")
    trie = P.prefix_trie(P.chained(P.turn_digests(df), heads=True), **kw)
    return sorted(map(tuple, trie.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("limit,crowd", [(1 << 18, 64), (3, 2), (50, 10_000)])
def test_against_brute_force(spark, table, limit, crowd):
    assert _got(spark, table[0], queue_limit=limit, least_crowd=crowd) == table[1]


def test_sql(table):
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", table[0])
    assert sorted(con.sql(P.oracle()).fetchall(), key=lambda r: r[:2]) == table[1]


def test_empty_and_plain(spark):
    assert _got(spark, [(None, 1, "u", "x")]) == []
    turns = P.turn_digests(spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a")],
                                                 "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.depth): (r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in P.prefix_trie(P.chained(turns)).collect()}
    assert got == {(1, 0): (2, 1, 1, 1), (1, 1): (2, 1, 1, 1), (1, 2): (1, 0, 1, 0)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(-5, 5), st.integers(0, 3))), st.integers(0, 6))
def test_queue(messages, limit):
    queue, want = SpillQueue(limit), defaultdict(list)
    for k, a, b in messages:
        queue.push(bytes([k]) * KEY, a, b)
        want[bytes([k]) * KEY].append((a, b))
    for k in sorted(want):
        assert queue.first() == k
        assert queue.take(k) == (len(want[k]), *map(sum, zip(*want[k])))
    assert queue.first() is None and queue.take(bytes(KEY)) == (0, 0, 0)
