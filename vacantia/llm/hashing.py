"""Words and word windows of many texts as 64-bit hashes, computed on whole Arrow buffers.

A word is a run of bytes without ``\\x20`` and ``\\x09-\\x0D``. All arithmetic is modulo
2**64. A word's hash is a polynomial over a random table of byte values; a window's hash
is a polynomial over its words' mixed hashes. Memory is a small multiple of the bytes
handed over at once, so callers cut their batches with ``slices``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
_ROWS = 4_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U(shift)
        x *= U(factor)
    x ^= x >> U(31)
    return x


@cache
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64) + U(1 + 1_000_003 * (seed + 1)))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``base**0 ... base**(n-1)``; grown by doubling and kept per worker."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, 2 * len(known) if known is not None else 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = known
    return known[:n]


BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = {base: pow(base, -1, 1 << 64) for base in (BYTE_BASE, WORD_BASE)}

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array | pa.ChunkedArray) -> pa.LargeBinaryArray:
    """A text column as bytes; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text, or one row if that is longer."""
    sizes = np.diff(_offsets(text_bytes(batch.column(text))))
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > limit or i - start >= _ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def _offsets(column: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


class Words:
    """The words of all texts of a column, in order.

    ``hash``: one number per word. ``first``: index of each text's first word, with the
    number of all words at the end. ``begin`` and ``end``: byte positions of each word in
    ``data``. ``outside`` marks the byte values that belong to no word.
    """

    def __init__(self, texts: pa.LargeBinaryArray, lower: bool = False, seed: int = 0, outside: np.ndarray = _IS_SPACE):
        offsets = _offsets(texts)
        base = offsets[0]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[base : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.data = _LOWER[data] if lower else data
        offsets = offsets - base
        inner = np.append(~outside[self.data], False)
        # A text ends its last word even if the next text begins with one.
        cut = np.zeros(len(inner), bool)
        cut[offsets] = True
        before = np.concatenate(([False], inner[:-1]))
        self.begin = np.flatnonzero(inner & (~before | cut))
        self.end = np.flatnonzero(before & (~inner | cut))
        self.first = np.searchsorted(self.begin, offsets)
        self.seed = seed

    def __len__(self) -> int:
        return len(self.begin)

    @property
    def hash(self) -> np.ndarray:
        if "_hash" not in self.__dict__:
            n = len(self.data)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_byte_values(self.seed)[self.data] * _powers(BYTE_BASE, n), out=sums[1:])
            shift = _powers(_INVERSE[BYTE_BASE], n + 1)[self.begin]
            self._hash = mix((sums[self.end] - sums[self.begin]) * shift)
        return self._hash

    @property
    def sums(self) -> np.ndarray:
        if "_sums" not in self.__dict__:
            n = len(self.begin)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.hash * _powers(WORD_BASE, n), out=self._sums[1:])
        return self._sums

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words ``begin`` to ``end - 1`` for each pair of word indexes."""
        shift = _powers(_INVERSE[WORD_BASE], len(self.begin) + 1)[begin]
        return mix((self.sums[end] - self.sums[begin]) * shift + (end - begin).astype(np.uint64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and text of every window of ``size`` words inside one text."""
        counts = np.diff(self.first)
        inside = np.maximum(counts - size + 1, 0)
        text = np.repeat(np.arange(len(counts)), inside)
        begin = np.arange(len(text)) - np.repeat(np.cumsum(inside) - inside, inside) + self.first[text]
        return begin, text
