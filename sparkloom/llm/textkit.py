"""Vectorised word and window kernels over Arrow string columns.

A batch of texts is one UTF-8 byte buffer plus document offsets.  Words are
maximal runs of bytes outside 0x20 and 0x09-0x0D, which is the same as
``[^\\x20\\x09-\\x0D]+`` over code points, as UTF-8 never uses those bytes inside
a longer character.  All hashes are polynomial prefix sums modulo 2**64 with a
random 64-bit value per byte, then mixed; two independent families give 128 bits.

Memory stays in proportion to one slice (``slices``): about ``SLICE_BYTES`` of
text, or one document where that is longer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 18

_RNG = np.random.default_rng(20240117)
_TABLES = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORD_BASES = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that continue a code point.
CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True

_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of its inverse."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        made = np.full(max(n, SLICE_BYTES + 1024 if n <= SLICE_BYTES + 1024 else n), step, np.uint64)
        made[0] = 1
        have = np.cumprod(made)
        if n > SLICE_BYTES + 1024:
            return have  # of one very long document: not kept
        _powers[base, inverse] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums before each position, one more than values."""
    out = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """Hashes of byte ranges of a buffer."""
    base, n = _BASES[family], len(buf)
    sums = prefix(_TABLES[family][buf] * powers(base, n + 1)[:n])
    return mix((sums[ends] - sums[starts]) * powers(base, n + 1, True)[starts] + (ends - starts).astype(np.uint64))


class Slice:
    """Some documents' bytes: buf, and where each starts (off, one more than documents)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        self.n_docs = len(off) - 1
        token = ~SPACE[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        start = token.copy()
        start[1:] &= ~token[:-1] | edge[1:-1]
        stop = token.copy()
        stop[:-1] &= ~token[1:] | edge[1:-1]
        self.token = token
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(stop) + 1
        #: Words before each document, one more than documents.
        self.word_off = np.searchsorted(self.starts, off)
        self.n_words = np.diff(self.word_off)
        self._sums: dict[int, np.ndarray] = {}

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Sums of a value for each byte, by document."""
        c = prefix(mask.astype(np.int64))
        return c[self.off[1:]] - c[self.off[:-1]]

    def per_doc_words(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value for each word, by document."""
        c = prefix(values.astype(np.float64 if values.dtype.kind == "f" else np.int64))
        return c[self.word_off[1:]] - c[self.word_off[:-1]]

    def spans(self, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
        """Hashes of byte ranges."""
        base, n = _BASES[family], len(self.buf)
        if family not in self._sums:
            self._sums[family] = prefix(_TABLES[family][self.buf] * powers(base, n + 1)[:n])
        sums = self._sums[family]
        return mix((sums[ends] - sums[starts]) * powers(base, n + 1, True)[starts] + (ends - starts).astype(np.uint64))

    def words(self, family: int = 0) -> np.ndarray:
        return self.spans(self.starts, self.ends, family)

    def word_doc(self) -> np.ndarray:
        """The document (its place in the slice) of each word."""
        return np.repeat(np.arange(self.n_docs), self.n_words)

    def windows(self, k: int, family: int = 0, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First words of the k-word windows inside one document (those of ``at``, if given), and their hashes."""
        if at is None:
            fits = self.word_off[1:].repeat(self.n_words) - np.arange(len(self.starts)) >= k
            at = np.flatnonzero(fits)
        h, n = self.words(family), len(self.starts)
        base = _WORD_BASES[family]
        sums = prefix(h * powers(base, n + 1)[:n])
        return at, mix((sums[at + k] - sums[at]) * powers(base, n + 1, True)[at] + np.uint64(k))

    def covered(self, at: np.ndarray, k: int) -> np.ndarray:
        """Which words lie in a k-word window that starts at one of these words."""
        d = np.zeros(len(self.starts) + 1, np.int32)
        d[at] += 1
        np.subtract.at(d, at + k, 1) if len(at) else None
        return np.cumsum(d[:-1]) > 0


def slices(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int, Slice]]:
    """Cuts a string column into slices of about SLICE_BYTES; a null is an empty text.

    Yields the first document, one past the last, and their slice.
    """
    for i, j, buf, off in _cut(column, most or SLICE_BYTES):
        yield i, j, Slice(buf, off)
    tidy()


def raw_slices(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The same slices as bytes and the documents' offsets in them, without the word kernel."""
    yield from _cut(column, most or SLICE_BYTES)
    tidy()


def _cut(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def _frugal() -> None:
    """Lets the C library return what is freed at a heap's end, and map large arrays on their own (its own thresholds grow with use)."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # another C library
        return


_frugal()


def tidy() -> None:
    """Gives memory back to the system, tables of powers too: workers live on between tasks, beside the JVM."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def repeated(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values within documents: which have an equal in the document, and which are not the first of their kind."""
    n = len(values)
    key = mix(values + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(n + 1, bool)
    same[1:n] = k[1:] == k[:-1]
    twice, later = np.zeros(n, bool), np.zeros(n, bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def lines(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """\\n-split lines that hold a word: document, first byte, one past the last byte."""
    if not len(s.buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    breaks = np.flatnonzero(s.buf == 0x0A)
    # A document's edge ends a line as well; an empty document gives none with a word.
    starts = np.union1d(s.off[:-1], breaks + 1)
    starts = starts[starts < len(s.buf)]
    nexts = np.append(starts[1:], len(s.buf))
    doc = np.searchsorted(s.off, starts, side="right") - 1
    ends = nexts.copy()
    # The line's own \n is no part of it.
    has = (ends > starts) & (s.buf[np.maximum(ends - 1, 0)] == 0x0A)
    ends = ends - has
    word = np.searchsorted(s.starts, ends) > np.searchsorted(s.starts, starts)
    return doc[word], starts[word], ends[word]
