"""Vectorised word and shingle primitives over Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+``. All work is on UTF-8 bytes: white space is ASCII, so byte and
code-point words coincide. Hashes are 64 bit; every constant is derived from ``splitmix64``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once, just below a power of two; a longer single text is handled alone, whole.
CHUNK_BYTES = (1 << 20) - 64

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = np.asarray(x, dtype=_U).copy()
    x += _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CASED = mix(np.arange(256))
_LOWER = _CASED.copy()
_LOWER[0x41:0x5B] = _CASED[0x61:0x7B]
_R = 0xD1342543DE82EF95
_RINV = pow(_R, -1, 1 << 64)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2**64, at least n of each; tables for chunks are kept."""
    if _POWERS and len(_POWERS[0][0]) >= n:
        return _POWERS[0]
    size = 1 << max(12, (n - 1).bit_length())
    steps = np.full(size, _R, dtype=_U)
    back = np.full(size, _RINV, dtype=_U)
    steps[0] = back[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(steps, out=steps)
        np.multiply.accumulate(back, out=back)
    if size <= CHUNK_BYTES + 64:
        _POWERS[:] = [(steps, back)]
    return steps, back


class Texts:
    """Some texts: their bytes, and the boundaries of words, which the bytes flagged in ``gaps`` part."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE):
        self.data = data
        self.offsets = offsets
        n = len(data)
        word = ~gaps[data]
        prev = np.empty(n + 1, dtype=bool)
        prev[0] = False
        prev[1:] = word
        inner = offsets[(offsets > 0) & (offsets < n)]
        before = prev[:-1].copy()
        before[inner] = False
        after = np.empty(n, dtype=bool)
        if n:
            after[:-1] = word[1:]
            after[-1] = False
            after[inner - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        #: of each text, the index of its first word; one more at the end
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word_hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word (A-Z lower-cased unless told otherwise) and of its length."""
        up, down = _powers(len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.empty(len(self.data) + 1, dtype=_U)
            total[0] = 0
            np.cumsum((_LOWER if lower else _CASED)[self.data] * up[: len(self.data)], out=total[1:])
            h = (total[self.ends] - total[self.starts]) * down[self.starts]
            return mix(h + (self.ends - self.starts).astype(_U))

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each window of ``width`` words inside one text, and the offsets of each text's windows."""
        counts = np.maximum(self.counts - width + 1, 0)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        if not bounds[-1]:
            return np.empty(0, dtype=_U), bounds
        at = np.arange(bounds[-1]) + np.repeat(self.first[:-1] - bounds[:-1], counts)
        return window_hashes(hashes, at, width), bounds


def window_hashes(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words from each position of ``at``."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), dtype=_U)
        for j in range(width):
            out = out * _U(_R) + hashes[at + j]
        return mix(out + _U(width))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind, count=len(column) + column.offset + 1)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """The column in chunks: first row, row after the last, their texts."""
    data, offsets = column_bytes(column)
    for i, j in chunks(offsets, limit):
        yield i, j, Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def shingle_sets(texts: Texts, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their offsets.

    A text of fewer than ``width`` words has its whole sequence as the one shingle; one without words has none.
    """
    hashes = texts.word_hashes()
    grams, bounds = texts.windows(hashes, width)
    counts = texts.counts
    sets: list[np.ndarray] = []
    for i in range(len(texts)):
        part = grams[bounds[i] : bounds[i + 1]]
        if len(part) > 1:
            part = np.sort(part)
            keep = np.empty(len(part), dtype=bool)
            keep[0] = True
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            part = part[keep]
        elif not len(part) and counts[i]:
            part = window_hashes(hashes, texts.first[i : i + 1], int(counts[i]))
        sets.append(part)
    lengths = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    return (np.concatenate(sets) if sets else np.empty(0, dtype=_U)), np.concatenate(([0], np.cumsum(lengths)))
