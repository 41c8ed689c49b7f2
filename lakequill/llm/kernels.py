"""Vectorised text kernels shared by the corpus operators.

Everything here works on the UTF-8 bytes of many documents at once: a column
of strings becomes one byte array plus row offsets, words become two arrays of
byte positions, and hashes of words and of word windows come from wrapped
polynomial prefix sums, so a window of any length costs the same.  Callers cut
their input with :func:`slices`, which bounds the scratch memory whatever the
size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; the scratch arrays take about 80 times as much.
SLICE_BYTES = 1 << 20

#: Rows handled at once, so that a row's number fits 16 bits.
MOST_ROWS = 1 << 16

#: Fixed value: the word separators of the query contracts, space and \t to \r.
SEPARATORS = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Text:
    """Bytes and row offsets of a string column; nulls count as empty."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "") if column.null_count else column
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        n = len(column)
        if n == 0 or data is None:
            self.bytes, self.offsets = np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
        else:
            at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
            self.bytes = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
            self.offsets = at - at[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, separators: bytes = SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and the first word of each row (one more at the end)."""
        inside = np.ones(256, bool)
        inside[list(separators)] = False
        inside = inside[self.bytes]
        full = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        ends = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        before[full] = False
        start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        after[ends - 1] = False
        end = np.flatnonzero(inside & ~after) + 1
        return start, end, np.searchsorted(start, self.offsets)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``most`` bytes of text each (and MOST_ROWS rows); a longer row stands alone."""
    at = Text(batch.column(column)).offsets
    i, n = 0, batch.num_rows
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1), i + MOST_ROWS)
        yield batch.slice(i, j - i)
        i = j


class Rolling:
    """Polynomial hashes modulo 2**64 of runs of items, from prefix sums.

    Made where it is used (a task), so that no table travels with a function.
    """

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.base = np.uint64(int(draw.integers(1 << 40, 1 << 60)) * 8 + 5)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.table = draw.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.up) <= n:
            m = max(n + 1, 2 * len(self.up))
            for name, by in (("up", self.base), ("down", self.inverse)):
                powers = np.full(m, by, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of the items, each times a power of the base."""
        self._reach(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the runs from start to end; equal runs have equal hashes wherever they stand."""
        return mix((sums[end] - sums[start]) * self.down[start])

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.between(self.sums(self.table[data]), start, end)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of every window of ``size`` words inside a row, and the row of each."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    return ranges(first[:-1], counts), row


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    jump = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return np.arange(total, dtype=np.int64) + jump
