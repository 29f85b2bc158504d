"""Splitting texts into the pieces that byte-level BPE merges within.

The pattern is that of the public rank files.  A single space between two
characters that are not white space always starts a new piece, so a text is
first cut there (``str.split``), the chunks are looked up in a bounded memo and
only new chunks are matched against the pattern."""

from __future__ import annotations

from collections.abc import Callable

import regex

from taxomatch.llm.common import Memo

#: Memo entries of one generation (two are held, some 150 bytes an entry).
CHUNKS = 120_000
PIECES = 20_000


class _Unclean(Exception):
    """A chunk that is empty or has white space at an end."""


class PieceReader:
    """``values(text)``: for each chunk of a text, ``join`` of the ``of_piece``
    values of its pieces (both are pure, so they are memoised per worker)."""

    def __init__(self, pattern: str, of_piece: Callable[[str], object], join: Callable[[list], object]):
        self.findall = regex.compile(pattern).findall
        self.of_piece, self.join = of_piece, join
        #: By chunk, without the space before it; a word of letters is one piece.
        self.chunk = Memo(self._chunk, CHUNKS, twice=True)
        #: Pieces that are not a space and letters.
        self.other = Memo(of_piece, PIECES)

    def _piece(self, piece: str):
        word = piece[1:]
        return self.chunk[word] if piece[0] == " " and word.isalpha() else self.other[piece]

    def _chunk(self, chunk: str):
        if chunk.isalpha():
            return self.of_piece(" " + chunk)
        # str.isspace is wider than the pattern's white space, which is safe here
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Unclean
        return self.join([self._piece(p) for p in self.findall(" " + chunk)])

    def whole(self, text: str) -> list:
        """The values of a text, by the pattern alone."""
        return [self.join([self._piece(p) for p in self.findall(text)])]

    def values(self, text: str) -> list:
        if len(text) < 2:
            return self.whole(text)
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + list(map(self.chunk.__getitem__, rest))
        except _Unclean:
            return self.whole(text)
