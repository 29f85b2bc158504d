"""Anchors of byte windows: the places whose suffixes need to be sorted.

Of the ``GRAM``-byte hashes in a window of ``WINDOW`` bytes the smallest (of
equal ones the last) marks the window's anchor.  Equal windows have their
anchor at the same offset, so windows are only equal if their anchors'
suffixes share a prefix.  Neighbouring windows mostly share an anchor: a
``chunk`` is a run of window starts with one anchor.
"""

from __future__ import annotations

import numpy as np
import xxhash

WINDOW = 200
GRAM = 32
#: Hashes of a window.
HASHES = WINDOW - GRAM + 1
#: Places worked on at a time; the low bits of a key hold the place.
SEGMENT = 1 << 20

_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=21) for b in range(256)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of ``GRAM`` bytes, by doubling."""
    h, size, factor = _BYTE[data], 1, int(_STEP)
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    h ^= h >> np.uint64(29)
    h *= _STEP
    h ^= h >> np.uint64(32)
    return h


def _lowest(keys: np.ndarray) -> np.ndarray:
    """Minimum of each run of ``HASHES`` keys, by doubling."""
    low, size = keys, 1
    while 2 * size <= HASHES:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = HASHES - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def chunks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, hash of the anchor's bytes) of each
    chunk of a text; none under ``WINDOW`` bytes."""
    parts = []
    flat = np.frombuffer(data, np.uint8)
    starts = len(data) - WINDOW + 1
    bits = np.uint64(20)
    for at in range(0, max(starts, 0), SEGMENT - WINDOW):
        size = min(SEGMENT - WINDOW, starts - at)
        h = gram_hashes(flat[at : at + size + WINDOW - 1])
        place = np.arange(len(h), dtype=np.uint64)
        # The smallest hash wins, then the last place.
        keys = (h >> bits << bits) | (np.uint64(SEGMENT - 1) - place)
        low = np.uint64(SEGMENT - 1) - (_lowest(keys) & np.uint64(SEGMENT - 1))
        low = low.astype(np.int64)
        first = np.nonzero(np.concatenate([[True], low[1:] != low[:-1]]))[0]
        last = np.append(first[1:], len(low)) - 1
        parts.append((low[first] + at, first + at, last + at, h[low[first]]))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))
