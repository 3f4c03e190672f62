"""Vectorised words, hashes and rolling windows over Arrow string columns.

Word separators are single ASCII bytes, so a column can be cut at byte level: no byte of a longer
UTF-8 character is ever a separator. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes at once; a longer text is a step of its own.
STEP_BYTES = 2_000_000
_HASH_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_BASE = np.uint64(0xD1342543DE82EF95)
_WORD_BASE_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def byte_table(separators: str) -> np.ndarray:
    """True for each byte that belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(separators.encode("latin-1"))] = False
    return table


#: Words are runs of everything but blank, tab, line feed, vertical tab, form feed and return.
NOT_SPACE = byte_table(" \t\n\x0b\x0c\r")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        row = 0
        while row < batch.num_rows:
            before = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(row, stop - row)
            row = stop


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of the texts of one Arrow column.

    ``first[d]`` to ``first[d + 1]`` are the numbers of the words of text ``d``.
    """

    def __init__(self, column: pa.Array | pa.ChunkedArray, table: np.ndarray, lower: bool = False):
        data, offsets = text_bytes(column)
        if lower:
            fold = np.arange(256, dtype=np.uint8)
            fold[65:91] += 32
            data = fold[data]
        self.data, self.offsets = data, offsets
        inside = table[data]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(data):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            filled = offsets[1:] > offsets[:-1]
            before[offsets[:-1][filled]] = False
            after[offsets[1:][filled] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def owners(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        out = np.zeros(len(self), np.uint64)
        word = 0
        while word < len(self):
            stop = max(word + 1, int(np.searchsorted(self.ends, self.starts[word] + _HASH_BYTES, "right")))
            low, high = self.starts[word], self.ends[stop - 1]
            n = int(high - low)
            powers = np.full(n + 1, _BASE)
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data[low:high].astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
            back = np.full(n + 1, _BASE_INVERSE)
            back[0] = 1
            np.multiply.accumulate(back, out=back)
            a, b = self.starts[word:stop] - low, self.ends[word:stop] - low
            out[word:stop] = mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
            word = stop
        return out

    def room(self, width: int) -> np.ndarray:
        """Numbers of the words at which ``width`` words of one text begin."""
        n = len(self)
        if n < width:
            return np.zeros(0, np.int64)
        left = np.repeat(self.first[1:], self.counts) - np.arange(n)
        return np.flatnonzero(left >= width)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` consecutive word hashes from each place; places at the end are left out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= _WORD_BASE
        out += hashes[j : j + n]
    return mix(out)


class SpanHashes:
    """Hashes of any span of a sequence of word hashes, from running sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        powers = np.full(n + 1, _WORD_BASE)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.back = np.full(n + 1, _WORD_BASE_INVERSE)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))
