"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15
#: Texts are hashed in pieces of so many bytes, cut at white space.
PIECE = 1 << 17
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_BLANKS = [bytes([c]) for c in (0x20, *range(0x09, 0x0E))]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordShingles:
    """Text to the sorted distinct hashes of its shingles of ``words`` words.

    Words are cut at ASCII white space and A-Z is lower-cased. A text with fewer words
    is one shingle, one without words has none. All words of a piece are hashed at
    once: a sum of byte values times powers of an odd base is taken over the piece, and
    a word's share of it, divided by the power at its start, is the same wherever the
    word stands. Words as long as a piece are hashed one by one.
    """

    def __init__(self, words: int):
        import xxhash

        self._whole, self._words = xxhash.xxh3_64_intdigest, words
        values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
        lower = [c + 32 if 65 <= c <= 90 else c for c in range(256)]
        self._value = values[lower]
        self._blank = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
        base = 0xD6E8FEB86659FD93
        inverse = pow(base, -1, 1 << 64)
        self._power, self._inverse = (
            np.cumprod(np.array([1] + [b] * PIECE, np.uint64)) for b in (base, inverse)
        )

    def _piece(self, raw: bytes) -> np.ndarray:
        own = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(own) + 2, bool)
        np.logical_not(self._blank[own], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(self._value[own] * self._power[: len(own)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self._inverse[starts])

    def words(self, text: str) -> np.ndarray:
        """Hashes of the words in order."""
        raw = text.encode()
        found, at = [], 0
        while at < len(raw):
            piece = raw[at : at + PIECE]
            if len(piece) == PIECE:
                cut = max(piece.rfind(blank) for blank in _BLANKS)
                if cut < 0:
                    blank = _BLANK.search(raw, at)
                    end = blank.start() if blank else len(raw)
                    found.append(np.array([self._whole(raw[at:end].lower())], np.uint64))
                    at = end
                    continue
                piece = piece[:cut]
            found.append(self._piece(piece))
            at += max(1, len(piece))
        return np.concatenate(found) if found else np.empty(0, np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        h = self.words(text)
        if not len(h):
            return np.empty(0, np.int64)
        k = min(self._words, len(h))
        rolled = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            rolled = mixed(rolled * np.uint64(_MULTIPLIER) + h[i : len(h) - k + 1 + i])
        rolled = np.sort(rolled.view(np.int64))
        return rolled[np.concatenate([[True], rolled[1:] != rolled[:-1]])]
