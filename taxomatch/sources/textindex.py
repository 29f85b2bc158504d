"""Substring search in a stored collection without reading every file.

For each file of a collection the index has the set of its texts' ``GRAM``-character
runs, hashed into ``BITS`` bits (a bitmap per file, at most ``BITS`` / 8 bytes
however large the file is).  A text that contains a needle contains all runs
of the needle, so a file that lacks the bit of one of them cannot hold a match and
is not read.  The other files are read and the needle is looked for in the texts,
so a hash collision costs a file read, never a row.

Files written after the last ``update`` have no bitmap and are always read; a
needle shorter than ``GRAM`` characters reads all files.  Files of a dropped
collection are no longer listed and are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxomatch.sources.collections import VectorStore, collection_name_py

GRAM = 4
#: Bits of one file, kept in pieces of ``PIECE``.
BITS = 1 << 20
PIECE = 1 << 15
#: Runs of a needle that are looked up.
PROBES = 256

_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def gram_bits(text: str) -> np.ndarray:
    """The bit numbers (from 0) of the ``GRAM``-character runs of a text, in text order."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(chars) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for i, factor in enumerate(_FACTORS):
        h += chars[i:i + n] * np.uint64(factor)
    h ^= h >> np.uint64(32)
    h *= np.uint64(_FACTORS[0])
    return (h >> np.uint64(64 - 20)).astype(np.int64)


def _file_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``file, text`` of a task, file after file -> the bitmap of each file in pieces;
    piece -1 (empty) says that the file is known."""
    def rows(file, seen):
        bits = np.packbits(seen, bitorder="little").reshape(-1, PIECE // 8)
        used = np.nonzero(bits.any(axis=1))[0]
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * (len(used) + 1), pa.string()), pa.array([-1, *used.tolist()], pa.int64()),
             pa.array([bytes(PIECE // 8), *(bits[i].tobytes() for i in used)], pa.binary())], names=["file", "piece", "bits"])

    file, seen = None, np.zeros(BITS, bool)
    for b in batches:
        for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if name != file:
                if file is not None:
                    yield rows(file, seen)
                file, seen = name, np.zeros(BITS, bool)
            if text:
                seen[gram_bits(text)] = True
    if file is not None:
        yield rows(file, seen)


def place(file: str) -> str:
    """A file of the store by its place under the root, however its path is written."""
    return unquote(file).rsplit("/side=", 1)[-1]


class TextIndex:
    """The index of one collection, kept beside the store as ``file, piece, bits``."""

    def __init__(self, store: VectorStore, side: str, model: str):
        self.store, self.side, self.model = store, side, model
        self.spark = store.spark
        self.path = f"{store.root}-runs/side={side}/model={collection_name_py(model)}"

    def files(self) -> list[str]:
        """The files of the collection (paths only, as the driver lists them for any scan)."""
        t = self.store.scan(self.side, self.model)
        return [] if t is None else t.inputFiles()

    def _table(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if self.store._exists(self.path) else None

    def _known(self) -> set[str]:
        t = self._table()
        return set() if t is None else {place(r.file) for r in t.select("file").distinct().collect()}

    def _read(self, files: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", self.store.root).parquet(*files)

    def update(self) -> int:
        """Index the files that have no bitmap yet; returns how many.

        A task sets the bits of a file's texts in one bitmap (``BITS`` / 8 bytes) and sends
        its used pieces; those of a file read by several tasks are combined."""
        known = self._known()
        new = [f for f in self.files() if place(f) not in known]
        if not new:
            return 0
        texts = self._read(new).select(F.col("_metadata.file_path").alias("file"), "text")
        pieces = (texts.mapInArrow(_file_pieces, "file string, piece long, bits binary")
                  .groupBy("file", "piece").agg(F.bitmap_or_agg("bits").alias("bits")))
        pieces.write.mode("append").parquet(self.path)
        return len(new)

    def candidates(self, needle: str) -> list[str]:
        """The files that may hold a text with ``needle``."""
        files = self.files()
        table = self._table()
        if table is None or len(needle) < GRAM:
            return files
        # some runs are enough to skip a file; the text itself is looked at in the rest
        want: dict[int, list[tuple[int, int]]] = {}
        for bit in list(dict.fromkeys(gram_bits(needle).tolist()))[:PROBES]:
            at = bit % PIECE
            want.setdefault(bit // PIECE, []).append((at // 8 + 1, 1 << at % 8))
        byte = lambda at: F.conv(F.hex(F.substring("bits", at, 1)), 16, 10).cast("int")
        has = F.lit(False)
        for piece, places in want.items():
            every = F.lit(True)
            for at, mask in places:
                every = every & (byte(at).bitwiseAND(F.lit(mask)) != 0)
            has = has | ((F.col("piece") == piece) & every)
        found = (table.groupBy("file").agg(F.count_if(has).alias("n"))
                 .select("file", (F.col("n") >= len(want)).alias("may")).collect())
        skip = {place(r.file) for r in found if not r.may}
        return [f for f in files if place(f) not in skip]

    def find(self, needle: str, with_vectors: bool = False) -> DataFrame:
        """The rows of ``VectorStore.find_text``, read from the candidate files only."""
        files = self.candidates(needle)
        if not files:
            none = self.store.vectors(self.side, self.model).where(F.lit(False))
            return none if with_vectors else none.drop("vec")
        t = self._read(files).where(F.col("text").contains(needle)).drop("side", "bucket")
        return t if with_vectors else t.drop("vec")
