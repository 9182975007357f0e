"""Words, lines and their hashes for a batch of texts, as numpy arrays over the UTF-8 bytes.

A task hands in Arrow string columns; pieces of a few MB are worked on at a
time, so memory is bounded by the piece and by the longest single text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
# Folding: ASCII and Latin-1 letters to lower case, every other ASCII character but digits to a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (splitmix64 finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        have = np.full(size, base, _U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * PIECE:
            _powers[base] = have
    return have[:n]


class Hasher:
    """Hashes of any byte ranges of one buffer, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=self.sums[1:])
        self.back = _power(_INVERSE, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(raw ^ (np.asarray(end - start).astype(_U) * _U(0xC2B2AE3D27D4EB4F)))


class Piece:
    """Some whole texts side by side: ``data`` holds their bytes, text i is ``data[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds
        self.n = len(bounds) - 1
        self.space = _SPACE[data]
        self._hasher = None

    @property
    def hasher(self) -> Hasher:
        if self._hasher is None:
            self._hasher = Hasher(self.data)
        return self._hasher

    def text(self, i: int) -> str:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes().decode("utf-8")

    def words(self):
        """``start, end, doc`` of the maximal runs without white space; a text's bounds end a word."""
        ink = ~self.space
        edge = np.zeros(len(ink) + 1, bool)
        edge[self.bounds] = True
        before = np.zeros(len(ink) + 1, bool)
        before[1:] = ink
        after = np.zeros(len(ink) + 1, bool)
        after[:-1] = ink
        start = np.flatnonzero(after & (~before | edge))
        end = np.flatnonzero(before & (~after | edge))
        return start, end, self.doc_of(start)

    def lines(self):
        r"""``start, end, doc`` of the lines: texts split at each ``\n``, which belongs to no line."""
        cut = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.bounds[:-1], cut + 1]), kind="stable")
        end = np.sort(np.concatenate([self.bounds[1:], cut]), kind="stable")
        doc = np.repeat(np.arange(self.n), self.per_doc(cut) + 1)
        return start, end, doc

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def per_doc(self, at: np.ndarray) -> np.ndarray:
        """How many of the sorted byte positions lie in each text."""
        return np.diff(np.searchsorted(at, self.bounds, side="left"))

    def total(self, value: np.ndarray, start=None, end=None) -> np.ndarray:
        """Sums of a per-byte value over ranges (default: over each text)."""
        sums = np.zeros(len(value) + 1, np.int64)
        np.cumsum(value, out=sums[1:])
        start, end = (self.bounds[:-1], self.bounds[1:]) if start is None else (start, end)
        return sums[end] - sums[start]


def _folded(data: np.ndarray) -> np.ndarray:
    out = _FOLD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1  # U+00C0 to U+00DE but the multiplication sign
    out[lead] += np.where((data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97), 0x20, 0).astype(np.uint8)
    return out


def pieces(column: pa.Array, size: int = PIECE, fold: bool | str = False):
    """Cut a string column into :class:`Piece` objects; a null text counts as empty.

    ``fold``: lower-case ASCII and Latin-1 letters, make ASCII punctuation white space (no byte moves);
    ``fold="lower"``: only lower-case ASCII letters.
    """
    texts = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        part = data[offsets[first]:offsets[last]]
        yield Piece(first, _LOWER[part] if fold == "lower" else _folded(part) if fold else part, offsets[first:last + 1] - offsets[first])
        first = last


def small(batches, rows: int = 1000):
    """The same rows in batches of ``rows`` at most, so Python objects of few texts are alive at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def rolling(hashes: np.ndarray, doc: np.ndarray, width: int):
    """Hash of every run of ``width`` words within one text: ``(position of its first word, hash)``."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(doc[:n] == doc[width - 1:])
    out = np.zeros(len(at), _U)
    for k in range(width):
        out = (out * _U(0x9E3779B97F4A7C15)) ^ hashes[at + k]
        out = mix(out)
    return at, out
