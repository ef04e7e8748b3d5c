"""Whole texts as numpy arrays: words, their hashes, and hashes of runs of words.

A word is a run of bytes other than blank and the controls 0x09 to 0x0D, so words can be found in the UTF-8
bytes of many texts at once. All hashes are 64-bit and alike in every task: a run's polynomial is a difference
of prefix sums times a power of the (odd, hence invertible) base, and is then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
"""Bytes of text handled at once; a longer text is a slice of its own."""

_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_VALUE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**64 - 1, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of ``x`` over all 64 (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as the longest slice so far needs."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64))))
                for b in (self.base, self.inverse)
            )
        return self.up, self.down


_BYTES = _Powers(0x9E3779B97F4A7C15)
_RUNS = (_Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F))


class RunHash:
    """Hashes of any runs of a sequence of 64-bit values; ``which`` chooses one of two independent bases."""

    def __init__(self, values: np.ndarray, which: int = 0):
        up, self.down = _RUNS[which].upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        run = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(run + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Texts:
    """A slice of a column of texts. Null texts count as empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        if len(at) == 0:
            at = np.zeros(1, np.int64)
        self.offsets = at - at[0]
        self.data = data[at[0] : at[-1]]
        if lower:
            self.data = _LOWER[self.data]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def spans(self, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of runs without a break, and each text's place among them (one more than texts)."""
        inside = ~breaks[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[edges - 1] = inside[edges - 1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.offsets)

    @cached_property
    def _words(self):
        return self.spans(_BREAK)

    @property
    def starts(self) -> np.ndarray:
        return self._words[0]

    @property
    def ends(self) -> np.ndarray:
        return self._words[1]

    @property
    def first_word(self) -> np.ndarray:
        """For each text the number of words before it; the last entry counts all words."""
        return self._words[2]

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    def run_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs of bytes."""
        up, down = _BYTES.upto(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    @cached_property
    def word_hash(self) -> np.ndarray:
        return self.run_hash(self.starts, self.ends)

    @cached_property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    def runs(self, length: int) -> np.ndarray:
        """The places of the words at which ``length`` words of one text begin."""
        of = self.text_of_word
        if len(of) < length:
            return np.zeros(0, np.int64)
        return np.flatnonzero(of[length - 1 :] == of[: len(of) - length + 1])


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of at most ``most`` bytes of text, or of one text."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = batch.column(at).cast(pa.large_binary())
        if not len(texts):
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]
