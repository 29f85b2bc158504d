"""A priority queue of sums that spills sorted runs.

Used by the time-forward pass of ``prefix_trie``: a message waits in the queue
until the node it is for comes up.  Up to ``limit`` messages wait in memory;
beyond it they are written as a sorted run to an unnamed file in the folder
that Spark gives its Python workers for spilling.  The file is private to the
task, holds nothing that another task reads and vanishes with the worker; a
task that is run again starts with an empty queue.
"""

from __future__ import annotations

import heapq
import os
import struct
import tempfile

KEY = 24
_RECORD = f">{KEY}sqq"
_SIZE = struct.calcsize(_RECORD)
_READ = 4096


def _spill_file():
    for folder in os.environ.get("SPARK_LOCAL_DIRS", "").split(","):
        if folder and os.path.isdir(folder):
            return tempfile.TemporaryFile(dir=folder)
    return tempfile.TemporaryFile()


class SpillQueue:
    """Messages (key of ``KEY`` bytes, two integers), taken out by ascending key."""

    def __init__(self, limit: int = 1 << 18):
        self.limit = limit
        self.young: list[tuple[bytes, int, int]] = []
        self.heads: list[tuple[tuple[bytes, int, int], int]] = []
        self.runs: dict = {}
        self.file = None
        self.spilled = 0

    def push(self, key: bytes, a: int, b: int) -> None:
        heapq.heappush(self.young, (key, a, b))
        if len(self.young) > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = _spill_file()
        self.young.sort()
        start = self.file.seek(0, os.SEEK_END)
        for i in range(0, len(self.young), _READ):
            self.file.write(b"".join(struct.pack(_RECORD, *m) for m in self.young[i : i + _READ]))
        run, self.spilled = self.spilled, self.spilled + 1
        self.runs[run] = self._records(start, len(self.young))
        self.young = []
        self._advance(run)

    def _records(self, start: int, n: int):
        for i in range(0, n, _READ):
            self.file.seek(start + i * _SIZE)
            yield from struct.iter_unpack(_RECORD, self.file.read(min(_READ, n - i) * _SIZE))

    def _advance(self, run: int) -> None:
        head = next(self.runs[run], None)
        if head is None:
            del self.runs[run]
        else:
            heapq.heappush(self.heads, (head, run))

    def first(self) -> bytes | None:
        """The smallest key that waits."""
        young = self.young[0][0] if self.young else None
        if self.heads and (young is None or self.heads[0][0][0] < young):
            return self.heads[0][0][0]
        return young

    def take(self, key: bytes) -> tuple[int, int, int]:
        """(how many messages have the key, the sums of their integers), all taken out."""
        n = a = b = 0
        while self.young and self.young[0][0] == key:
            m = heapq.heappop(self.young)
            n, a, b = n + 1, a + m[1], b + m[2]
        while self.heads and self.heads[0][0][0] == key:
            m, run = heapq.heappop(self.heads)
            n, a, b = n + 1, a + m[1], b + m[2]
            self._advance(run)
        return n, a, b
