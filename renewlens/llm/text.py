"""Words of whole texts: patterns for Column expressions and vectorised splitting for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: A word without punctuation: ASCII digits, lower-case letters and everything beyond ASCII.
BARE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte tables: 0 where a byte ends a word, else the byte that stands for it. UTF-8 keeps all these
#: separators to single bytes, so words can be cut in the encoded text.
_BYTES = np.arange(256, dtype=np.uint8)
PLAIN = _BYTES.copy()
PLAIN[0] = 1  # U+0000 belongs to words; its stand-in only has to differ from 0
PLAIN[[0x20, *range(0x09, 0x0E)]] = 0
LOWERED = PLAIN.copy()
LOWERED[65:91] += 32
BARE = np.zeros(256, dtype=np.uint8)
for _span in (range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)):
    BARE[list(_span)] = list(_span)
BARE[65:91] = _BYTES[97:123]

#: Bytes of text worked on at once inside a task.
SLICE_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15
_GRAM_BASE = 0xC2B2AE3D27D4EB4F
_ALL = (1 << 64) - 1


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def count_words(text: Column) -> Column:
    """Words of a text; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, longer on demand."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = _powers(self.base, size)
            self.down = _powers(pow(self.base, -1, 1 << 64), size)
        return self.up[:n], self.down[:n]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out


_BYTE_POWERS, _GRAM_POWERS = _Powers(_BASE), _Powers(_GRAM_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of several texts, in order."""

    raw: np.ndarray  # bytes of all texts, a blank after each
    data: np.ndarray  # the same through a byte table; 0 between words
    first: np.ndarray  # offset of each text, and the end
    start: np.ndarray  # byte range of each word
    end: np.ndarray
    count: np.ndarray  # words of each text

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    @property
    def bounds(self) -> np.ndarray:
        """Number of the first word of each text, and of all words."""
        return np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = _BYTE_POWERS.get(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(self.data * up[:-1], out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * down[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64) * np.uint64(_GRAM_BASE))

    def arrow(self) -> pa.Array:
        """The words as an Arrow array, byte for byte."""
        inside = self.data != 0
        offsets = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int32)
        return pa.Array.from_buffers(
            pa.binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(self.raw[inside])]
        )

    def ids(self) -> tuple[np.ndarray, int]:
        """Exact word numbers, equal for equal words, and how many there are."""
        found = self.arrow().dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(found.dictionary)


def words(texts: pa.Array, table: np.ndarray = PLAIN) -> Words:
    """Split texts; nulls have no words."""
    n = len(texts)
    texts = texts.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
    lengths = np.diff(offsets)
    joined = pc.binary_join(pa.ListArray.from_arrays([0, n], texts), " ")
    buffer, total = joined.buffers()[2], int(lengths.sum()) + max(0, n - 1)
    raw = np.frombuffer(buffer, np.uint8, total) if total else np.zeros(0, np.uint8)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    data = table[raw]
    edge = np.diff((data != 0).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    count = np.diff(np.searchsorted(start, first))
    return Words(raw, data, first, start, end, count)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words; windows may run past the end of a text."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = _GRAM_POWERS.get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) + 1 - n])


def inside_text(found: Words, n: int) -> np.ndarray:
    """For every window of n words whether it lies in one text."""
    total = len(found.start)
    if total < n:
        return np.zeros(0, dtype=bool)
    last = np.repeat(found.bounds[1:], found.count)
    return np.arange(total - n + 1) + n <= last[: total - n + 1]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece hold about ``limit`` bytes, one text at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes + 1)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def per_text(found: Words, values: np.ndarray) -> np.ndarray:
    """Sum of a per-word value over each text."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return np.diff(sums[found.bounds])


def binary_rows(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """Rows of raw bytes: row i holds values[offsets[i]:offsets[i + 1]]."""
    data = np.ascontiguousarray(values).view(np.uint8)
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer((offsets * values.dtype.itemsize).astype(np.int64)), pa.py_buffer(data)],
    )
