"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece there is one token that can end its encoding: the
token ``t`` that is a suffix of the prefix and for which the pair (last token
of the prefix without ``t``, ``t``) is itself an encoding.  ``last[i]`` stores
that token for the prefix of ``i`` bytes, so

* encoding walks the table once and reads the ids backwards,
* appending bytes extends the table (earlier entries never change),
* an edit keeps the entries before it, and recomputes entries behind it only
  until they agree with the old ones over a whole longest token.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxomatch.llm.common import Memo, with_text_columns, worker_store
from taxomatch.llm.pieces import PieceReader

PAIRS = 150_000
PREFIXES = 60_000
#: Pieces up to this many bytes look their prefixes up in the shared table (by recursion).
SHORT = 64


class Vocabulary:
    """Ranks of a public rank file: one ``base64 rank`` pair per line."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.longest = max(map(len, self.rank))
        self.token: list[bytes] = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        #: Are two tokens, side by side, the encoding of their bytes?
        self.pair = Memo(self._pair, PAIRS)
        #: Is a token the encoding of its own bytes?
        self.alone = Memo(lambda t: self.merged(self.token[t]) == [self.token[t]], PAIRS)

    def merged(self, data: bytes) -> list[bytes]:
        """The definition: merge the adjacent pair of lowest rank until none is
        left.  Only for the few bytes of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.rank
        ranks = [rank.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == 1 << 40:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], 1 << 40)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], 1 << 40)
        return parts

    def _pair(self, key: int) -> bool:
        a, b = self.token[key >> 32], self.token[key & 0xFFFFFFFF]
        return self.merged(a + b) == [a, b]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Prefixes:
    """The table of one piece: ``last[i]`` is the token that ends the encoding
    of the first ``i`` bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _entry(self, data: bytes, last: list[int], end: int) -> int:
        v = self.vocabulary
        rank, pair, token = v.rank, v.pair, v.token
        for size in range(min(v.longest, end), 0, -1):
            t = rank.get(data[end - size : end])
            if t is None:
                continue
            before = last[end - size]
            if (v.alone[t] if before < 0 else pair[before << 32 | t]):
                return t
        raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._entry(self.data, self.last, end))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of the bytes from ``start`` to ``stop``.  Returns
        the number of entries that were computed anew."""
        data = self.data[:start] + new + self.data[stop:]
        old, shift = self.last, len(data) - len(self.data)
        last = old[: start + 1]
        same, done = 0, 0
        for end in range(start + 1, len(data) + 1):
            last.append(self._entry(data, last, end))
            done += 1
            behind = end - (start + len(new))
            same = same + 1 if behind > 0 and last[-1] == old[end - shift] else 0
            # An entry depends on the bytes and entries of one longest token before it.
            if same >= self.vocabulary.longest:
                last += old[end - shift + 1 :]
                break
        self.data, self.last = data, last
        return done

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            t = self.last[at]
            out.append(t)
            at -= len(self.vocabulary.token[t])
        return out[::-1]


class Encoder:
    """Encodes each match of ``pattern`` by itself; ids as little-endian bytes."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        #: prefix of a piece -> the last token of its encoding
        self.last = Memo(self._last, PREFIXES)
        self.reader = PieceReader(pattern, self._piece, b"".join)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.rank.get(data)
        if whole is not None and self.vocabulary.alone[whole]:
            return struct.pack("<I", whole)
        ids = self.short(data) if len(data) <= SHORT else Prefixes(self.vocabulary, data).ids()
        return struct.pack(f"<{len(ids)}I", *ids)

    def _last(self, prefix: bytes) -> int:
        """The token that ends the encoding of a prefix: the longest one that
        follows the last token of what stands before it."""
        v = self.vocabulary
        get, pair = v.rank.get, v.pair
        for start in range(max(0, len(prefix) - v.longest), len(prefix)):
            t = get(prefix[start:])
            if t is not None and (pair[self.last[prefix[:start]] << 32 | t] if start else v.alone[t]):
                return t
        raise ValueError(f"byte {prefix[-1]} is not in the vocabulary")

    def short(self, data: bytes) -> list[int]:
        """The ids of a short piece.  The table of last tokens is shared by all
        pieces (many begin alike) and filled on demand: only the prefixes that the
        last token leads back to are worked out."""
        token, last, out, at = self.vocabulary.token, self.last, [], len(data)
        while at:
            t = last[data[:at]]
            out.append(t)
            at -= len(token[t])
        return out[::-1]

    def encode(self, text: str) -> bytes:
        return b"".join(self.reader.values(text))


def owner(path: str) -> str:
    return f"byte-bpe {path}"


def encoder(path: str, pattern: str) -> Encoder:
    store = worker_store(owner(path))
    if "encoder" not in store:
        store["encoder"] = Encoder(path, pattern)
    return store["encoder"]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = True) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with ``ids``,
    ``token_ids`` (``array<int>``).

    A null text counts as empty (no ids); every row is kept, repeated ones
    included; existing columns of these names are replaced.  The decoded digest
    is that of the bytes read back from the ids, not of the text.  ``path``
    names a rank file present on every node.
    """
    new = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        new = new.add("token_ids", T.ArrayType(T.IntegerType()))

    def maker():
        enc = encoder(path, pattern)
        decode = enc.vocabulary.decode

        def of(texts: pa.Array) -> list[pa.Array]:
            packed = [enc.encode(t or "") for t in texts.to_pylist()]
            arrays = [np.frombuffer(p, "<u4") for p in packed]
            cols = [
                pa.array([len(a) for a in arrays], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                pa.array([hashlib.sha256(decode(a.tolist())).hexdigest() for a in arrays], pa.string()),
            ]
            if ids:
                flat = np.concatenate([*arrays, np.empty(0, "<u4")]).astype(np.int32)
                offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            return cols

        return of

    return with_text_columns(df, text, new, maker, owner(path))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes of the ids (``binary``; null ids give null)."""
    @F.pandas_udf("binary")
    def back(s):
        v = encoder(path, pattern).vocabulary
        return s.map(lambda x: None if x is None else v.decode(x))

    return df.withColumn(out, back(F.col(f"`{ids}`")))
