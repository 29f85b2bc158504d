"""Front-coded sorted runs of suffixes and their merge.

A run is a sorted list of ``WINDOW``-byte suffixes (shorter ones at the end of
a text are filled up with zero bytes); each is sent as the length of the
prefix it shares with the one before and the bytes after that prefix.  Runs are
merged by a loser tree that keeps, for every suffix in play, the length of the
prefix it shares with the last winner: of two suffixes the one that shares more
comes first, and only if both share the same are bytes compared, from there on.
"""

from __future__ import annotations

import numpy as np

from taxomatch.llm.suffix_anchors import HASHES, WINDOW, _BYTE, _STEP


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two ``WINDOW``-byte strings whose first
    ``start`` bytes are known to be equal."""
    u, v = a[start:], b[start:]
    if u == v:
        return WINDOW
    differ = int.from_bytes(u) ^ int.from_bytes(v)
    return WINDOW - (differ.bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> tuple[bytes, bytes]:
    """(shared lengths, the remaining bytes) of a sorted run."""
    shared, rest, before = [], [], None
    for s in suffixes:
        n = 0 if before is None else shared_prefix(before, s)
        shared.append(n)
        rest.append(s[n:])
        before = s
    return np.array(shared, "<u2").tobytes(), b"".join(rest)


def expand(shared: bytes, rest: bytes) -> tuple[list[bytes], list[int]]:
    """The suffixes and shared lengths of a front-coded run."""
    lengths = np.frombuffer(shared, "<u2").tolist()
    out, at, before = [], 0, b""
    for n in lengths:
        before = before[:n] + rest[at : at + WINDOW - n]
        at += WINDOW - n
        out.append(before)
    return out, lengths


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs: ((run, place) in order, prefix shared with the one before)."""
    runs = [r for r in runs]
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    ends = [len(s) for s, _ in runs] + [0] * (leaves - len(runs))
    suffix = [s for s, _ in runs] + [[]] * (leaves - len(runs))
    length = [n for _, n in runs] + [[]] * (leaves - len(runs))
    place = [0] * leaves
    #: Prefix shared with the last winner that passed; -1: the run is used up.
    known = [0 if e else -1 for e in ends]
    losers = [0] * leaves

    def beaten(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        if ka < 0:
            return a, b
        x, y = suffix[a][place[a]], suffix[b][place[b]]
        n = shared_prefix(x, y, ka)
        if n == WINDOW or x[n] < y[n]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    winners = list(range(leaves))
    level = leaves // 2
    while level:
        next_winners = []
        for i in range(level):
            w, lost = beaten(winners[2 * i], winners[2 * i + 1])
            losers[level + i] = lost
            next_winners.append(w)
        winners, level = next_winners, level // 2
    order, shared = [], []
    w = winners[0] if winners else 0
    while known[w] >= 0:
        order.append((w, place[w]))
        shared.append(known[w])
        place[w] += 1
        # Front coding gives the prefix that the next of this run shares with the winner.
        known[w] = length[w][place[w]] if place[w] < ends[w] else -1
        node = (w + leaves) // 2
        while node:
            w, losers[node] = beaten(w, losers[node])
            node //= 2
    return order, shared


def repeated_starts(shared: np.ndarray, left: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which windows around sorted anchors occur twice or more.

    ``shared``: prefix that each anchor's suffix shares with the one before;
    ``left``: the ``HASHES - 1`` bytes before each anchor; ``least``/``most``: the
    distances from window start to anchor that belong to the anchor.  Returns a
    matrix: is the window that starts ``l`` bytes before the anchor repeated?

    Two windows with the anchor at distance ``l`` are equal if the suffixes share
    ``WINDOW - l`` bytes (neighbours in order with no smaller value between them)
    and the ``l`` bytes before are the same (compared by a 64-bit hash)."""
    n = len(shared)
    out = np.zeros((n, HASHES), bool)
    before = np.zeros(n, np.uint64)
    for distance in range(HASHES):
        if distance:
            before = before * _STEP + _BYTE[left[:, HASHES - 1 - distance]]
        own = np.nonzero((least <= distance) & (distance <= most))[0]
        if len(own) < 2:
            continue
        cluster = np.cumsum(shared < WINDOW - distance)[own]
        h = before[own]
        order = np.lexsort((h, cluster))
        c, h = cluster[order], h[order]
        same = (c[1:] == c[:-1]) & (h[1:] == h[:-1])
        hit = np.zeros(len(own), bool)
        hit[1:] |= same
        hit[:-1] |= same
        out[own[order[hit]], distance] = True
    return out
