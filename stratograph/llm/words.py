"""Words and word windows of many texts at once, as arrays of 64-bit hashes.

Words are runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return. Everything here
works on the UTF-8 bytes of a batch of texts laid end to end.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_MASK = (1 << 64) - 1


def _mix_int(x: int) -> int:
    """One round of the public SplitMix64 generator's finisher."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _MASK
    return x ^ x >> 31


def mix(x: np.ndarray) -> np.ndarray:
    """The same on an array of uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_BASE = _mix_int(7) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.array([_mix_int(1000 + b) for b in range(256)], np.uint64)
_LOWER_VALUE = _BYTE_VALUE.copy()
_LOWER_VALUE[65:91] = _BYTE_VALUE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of texts: ``hash`` by word, ``doc`` (which text), ``first`` (each text's first word; one more at the end),
    ``begin`` and ``end`` in the bytes ``data``."""

    def __init__(self, texts: Sequence[str | None], lower: bool) -> None:
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.n = len(encoded)
        self.data = data = np.frombuffer(b" ".join([*encoded, b""]), np.uint8)
        sizes = np.fromiter(map(len, encoded), np.int64, self.n)
        self.doc_begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        word = np.empty(len(data) + 2, bool)
        word[0] = word[-1] = False
        np.logical_not(_IS_SPACE[data], out=word[1:-1])
        edges = np.flatnonzero(word[1:] != word[:-1])
        self.begin, self.end = edges[::2], edges[1::2]
        self.doc = np.searchsorted(self.doc_begin, self.begin, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))
        value = (_LOWER_VALUE if lower else _BYTE_VALUE)[data]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value * _powers(_BASE, len(data)), out=sums[1:])
        shift = _powers(_INVERSE, len(data) + 1)
        self.hash = mix((sums[self.end] - sums[self.begin]) * shift[self.begin] ^ (self.end - self.begin).astype(np.uint64) << np.uint64(48))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``size`` words within a text, and the run's first word."""
        if len(self.hash) < size:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[: len(self.doc) - size + 1] == self.doc[size - 1 :])
        found = np.full(len(at), size, np.uint64)
        for k in range(size):
            found = (found ^ self.hash[at + k]) * np.uint64(0x9FB21C651E98DF25)
            found ^= found >> np.uint64(32)
        return mix(found), at

    def whole(self, doc: int) -> np.uint64:
        """Hash of all words of a text as one sequence."""
        words = self.hash[self.first[doc] : self.first[doc + 1]]
        found = len(words)
        for w in words.tolist():
            found = ((found ^ w) * 0x9FB21C651E98DF25) & _MASK
            found ^= found >> 32
        return np.uint64(_mix_int(found))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles of each text, sorted: their hashes, and where each text's begin (one more at the end). A
        text of fewer words than ``size`` has its whole sequence as one shingle, a text without words none."""
        found, at = self.windows(size)
        doc = self.doc[at]
        count = np.diff(self.first)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            found = np.concatenate([found, np.array([self.whole(d) for d in short], np.uint64)])
            doc = np.concatenate([doc, short])
        order = np.lexsort((found, doc))
        found, doc = found[order], doc[order]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
        found, doc = found[keep], doc[keep]
        return found, np.searchsorted(doc, np.arange(self.n + 1))
