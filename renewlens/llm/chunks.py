"""Texts cut at blanks that every tokenizer here cuts at, and their distinct pieces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Last two bytes of white space beyond ASCII, in UTF-8 (some other characters share them).
_SPACES = np.zeros(1 << 16, dtype=bool)
for _tail in (0xC285, 0xC2A0, 0x9A80, *range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F):
    _SPACES[_tail] = True


@dataclass
class Chunks:
    """Consecutive pieces of several texts, cut before blanks that follow no white space."""

    raw: np.ndarray  # bytes of all texts
    start: np.ndarray  # byte range of each piece
    end: np.ndarray
    count: np.ndarray  # pieces of each text

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """The different pieces, and for every piece which one it is."""
        offsets = np.concatenate([self.start, self.end[-1:]]).astype(np.int32)
        coded = pa.Array.from_buffers(
            pa.binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(self.raw)]
        ).dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def chunks(texts: pa.Array, lead: str = "") -> Chunks:
    """Cut ``lead`` + text of each text; a null counts as empty, and nothing has no pieces.

    A blank that ends its text is no cut. The pieces start with a blank whose neighbour before is a character other than white space. No
    match of a tokenizer's split pattern spans such a place, because blanks stand only at the start
    of a match or in a run of white space, and nothing before a match decides about it.
    """
    n = len(texts)
    texts = pc.binary_join_element_wise(lead, texts.cast(pa.string()).fill_null(""), "")
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays([0, n], texts), "")
    total = int(lengths.sum())
    raw = np.frombuffer(joined.buffers()[2], np.uint8, total) if total else np.zeros(0, np.uint8)
    first = np.concatenate([[0], np.cumsum(lengths)])
    cut = np.zeros(total + 1, dtype=bool)
    if total > 1:
        tail = raw[:-1].astype(np.uint16)
        tail[1:] += raw[:-2].astype(np.uint16) << np.uint16(8)
        solid = (raw[:-1] > 0x20) & (raw[:-1] != 0x7F) & ~((raw[:-1] >= 0x80) & _SPACES[tail])
        cut[1:-1] = (raw[1:] == 0x20) & solid
        cut[first[1:] - 1] = False
    cut[first[:-1]] = True
    cut[total] = False
    start = np.flatnonzero(cut)
    count = np.diff(np.searchsorted(start, first))
    return Chunks(raw, start, np.append(start[1:], total)[:len(start)], count)


class Memo:
    """Results by piece. Beyond a number of new entries those not asked for again since are dropped.

    Long pieces are not kept.
    """

    def __init__(self, make: Callable[[list[bytes]], list[Any]], entries: int = 100_000, longest: int = 64):
        self.make, self.entries, self.longest = make, entries, longest
        self.young: dict[bytes, Any] = {}
        self.old: dict[bytes, Any] = {}

    def get(self, pieces: list[bytes]) -> list[Any]:
        """Results of distinct pieces; those not kept are made together."""
        young, old = self.young, self.old
        new = [p for p in pieces if p not in young and p not in old]
        made = dict(zip(new, self.make(new)))
        out = []
        for p in pieces:
            x = young.get(p)
            if x is None:
                x = made[p] if p in made else old[p]
                if len(p) <= self.longest:
                    young[p] = x
            out.append(x)
        if len(young) > self.entries:
            self.young, self.old = {}, young
        return out


def gather(values: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Concatenation of runs of ``values``: run k has sizes[k] values, and ``pick`` lists runs."""
    ends = np.cumsum(sizes)
    taken = sizes[pick]
    shift = np.repeat((ends - sizes)[pick] - (np.cumsum(taken) - taken), taken)
    return values[shift + np.arange(len(shift))]
