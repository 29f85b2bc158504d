"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a piece form a linked list; a heap holds the adjacent pairs
that have a merge, by rank and then place.  The lowest pair is popped and
merged until the heap is empty; the count is the number of symbols at the
start minus the number of merges.  No token ids are put out.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from taxomatch.llm.common import with_text_columns, worker_store
from taxomatch.llm.pieces import PieceReader


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in character of each byte in byte-level vocabularies:
    printable Latin-1 characters stand for themselves, the other bytes take the
    code points from 256 on, in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    table = {b: chr(b) for b in own}
    rest = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeCounter:
    """Counts tokens as the tokenizer file says: special strings in the text are
    single tokens, the pieces between them are merged by rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.symbol = byte_alphabet()
        ids: dict[str, int] = {c: b for b, c in self.symbol.items()}
        #: left id << 24 | right id -> rank << 24 | merged id
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merged = ids.setdefault(left + right, len(ids))
            self.merges.setdefault(ids[left] << 24 | ids[right], rank << 24 | merged)
        # Longer special strings win where two start at one place.
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.reader = PieceReader(pattern, self.count_piece, sum)

    def count_piece(self, piece: str) -> int:
        return self.count_symbols(piece.encode())

    def count_symbols(self, data: bytes) -> int:
        n = len(data)
        if n < 2:
            return n
        get = self.merges.get
        # A heap entry is (rank, merged id, place) in one integer; of equal ranks
        # the first place comes first, since a rank has one merged id.
        heap = [m << 40 | i for i, pair in enumerate(zip(data, data[1:]))
                if (m := get(pair[0] << 24 | pair[1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        ids, after, before = list(data), list(range(1, n + 1)), list(range(-1, n - 1))
        push, pop = heapq.heappush, heapq.heappop
        merged = 0
        while heap:
            entry = pop(heap)
            i, m = entry & 0xFFFFFFFFFF, entry >> 40
            j = after[i]
            # Stale unless the pair at i is still the one that was pushed.
            if j >= n or ids[i] < 0 or get(ids[i] << 24 | ids[j]) != m:
                continue
            merged += 1
            new = m & 0xFFFFFF
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := get(new << 24 | ids[k])) is not None:
                    push(heap, m << 40 | i)
            h = before[i]
            if h >= 0 and (m := get(ids[h] << 24 | new)) is not None:
                push(heap, m << 40 | h)
        return n - merged

    def count(self, text: str) -> int:
        parts, specials = [text], 0
        for s in self.special:
            if s in text:
                cut = [p.split(s) for p in parts]
                specials += sum(len(c) - 1 for c in cut)
                parts = [x for c in cut for x in c]
        return specials + sum(sum(self.reader.values(p)) for p in parts if p)


def owner(path: str) -> str:
    return f"token-count {path}"


def counter(path: str, pattern: str) -> MergeCounter:
    store = worker_store(owner(path))
    if "counter" not in store:
        store["counter"] = MergeCounter(path, pattern)
    return store["counter"]


def token_counts(df: DataFrame, path: str, pattern: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    A null text counts as empty (0 bytes, 0 tokens); every row is kept,
    repeated ones included; existing columns of these names are replaced.
    ``path`` names a tokenizer file present on every node.
    """
    new = T.StructType().add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def maker():
        count = counter(path, pattern).count

        def of(texts: pa.Array) -> list[pa.Array]:
            texts = pc.fill_null(texts, "")
            n = pa.array([count(t) for t in texts.to_pylist()], pa.int64())
            return [pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)]

        return of

    return with_text_columns(df, text, new, maker, owner(path))
