"""Byte-level BPE as a monoid: halves are encoded, neighbours joined by re-encoding their seam.

For the merges of rank files a sequence of tokens is the encoding of its bytes exactly if the bytes of
every two neighbours encode to these two. Up to the first merge across a border, both sides change as
they would alone, so that merge would happen between the two neighbours alone as well; and a border
no merge crosses in the whole is crossed by none between two neighbours. Hence a seam may be
re-encoded in a window of tokens, and all tokens outside stand once the two pairs at its edges hold.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from renewlens.llm.chunks import Memo, chunks, gather
from renewlens.llm.text import slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes that are encoded directly, at the leaves of the tree.
LEAF = 24
#: Windows up to this many bytes come again in many matches and are remembered.
REMEMBERED = 16
#: Bytes up to which a scan for the lowest pair is faster than a queue; the rank of no token.
SHORT, NONE = 64, 1 << 62
#: Ids that are decoded together, at the leaves of the other tree.
LEAF_IDS = 1 << 16
#: What a worker remembers: pairs that hold or not, ids of matches and of pieces between blanks.
PAIRS, MATCHES, PIECES = 200_000, 100_000, 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeEncoder:
    """Encoder of single matches of the split pattern."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF, pairs: int = PAIRS):
        self.ranks, self.leaf, self.pairs = ranks, leaf, pairs
        self.holding: dict[tuple[bytes, bytes], bool] = {}
        self.short: dict[bytes, list[bytes]] = {}

    def encode(self, match: bytes) -> list[int]:
        """Ids of a match; one that is a token itself is that token."""
        whole = self.ranks.get(match)
        if whole is not None:
            return [whole]
        return [self.ranks[t] for t in self.tree(match)]

    def tree(self, data: bytes) -> list[bytes]:
        """Tokens of the bytes: those of both halves, joined."""
        if len(data) <= self.leaf:
            return self.seam(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Encoding of two neighbours: a window over the seam doubles until both its edges hold."""
        reach = 1
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            inner = self.seam(b"".join(left[a:] + right[:b]))
            if (a == 0 or self.holds(left[a - 1], inner[0])) and (b == len(right) or self.holds(inner[-1], right[b])):
                return left[:a] + inner + right[b:]
            reach *= 2

    def seam(self, data: bytes) -> list[bytes]:
        """Tokens of a leaf or window."""
        found = self.short.get(data)
        if found is None:
            found = self.merged(data)
            if len(data) <= REMEMBERED:
                if len(self.short) >= self.pairs:
                    self.short.clear()
                self.short[data] = found
        return found

    def holds(self, a: bytes, b: bytes) -> bool:
        """Whether the bytes of two tokens encode to the two."""
        found = self.holding.get((a, b))
        if found is None:
            if len(self.holding) >= self.pairs:
                self.holding.clear()
            found = self.holding[a, b] = self.merged(a + b) == [a, b]
        return found

    def merged(self, data: bytes) -> list[bytes]:
        """Merge neighbours, lowest rank first and leftmost of equal ranks, until no pair is a token."""
        if len(data) > SHORT:
            return self._merged_long(data)
        get, size = self.ranks.get, len(data)
        at = list(range(size + 1))  # starts of the tokens, and the end
        rank = [get(data[i:i + 2], NONE) for i in range(size - 1)]  # of each token with the next
        while rank:
            low = min(rank)
            if low == NONE:
                break
            i = rank.index(low)
            del at[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(data[at[i]:at[i + 2]], NONE)
            if i:
                rank[i - 1] = get(data[at[i - 1]:at[i + 1]], NONE)
        return [data[a:b] for a, b in zip(at, at[1:])]

    def _merged_long(self, data: bytes) -> list[bytes]:
        """The same with a queue of pairs, whose time grows little faster than the bytes."""
        n, ranks = len(data), self.ranks
        end = list(range(1, n + 1))  # end of the token that starts here
        before = list(range(-1, n))  # start of the token before
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, stop = heappop(queue)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two has been merged since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                r = ranks.get(data[i:end[stop]])
                if r is not None:
                    heappush(queue, (r, i, end[stop]))
            j = before[i]
            if j >= 0:
                r = ranks.get(data[j:stop])
                if r is not None:
                    heappush(queue, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(data[i:end[i]])
            i = end[i]
        return out


class LeafEncoder:
    """Encodes many matches of at most LEAF bytes side by side: the same merges, one of each at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=0) + 1
        pairs = {
            ranks[t[:k]] * size + ranks[t[k:]]: r
            for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        }
        self.size, self.none = size, np.int64(size)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()] + [size], dtype=np.int64)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make, or ``none``."""
        wanted = a * self.size + b
        at = np.searchsorted(self.keys, wanted)
        found = self.keys[np.minimum(at, len(self.keys) - 1)] == wanted
        return self.merged[np.where(found & (a >= 0) & (b >= 0), at, len(self.keys))]

    def encode(self, matches: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(matches)
        sizes = np.array([len(m) for m in matches])
        for low, high in ((0, 6), (6, 10), (10, 16), (16, LEAF)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            data = b"".join([matches[k].ljust(high, b"\0") for k in rows.tolist()])
            ids = self.byte[np.frombuffer(data, np.uint8).reshape(len(rows), high)]
            ids[np.arange(high) >= sizes[rows, None]] = -1
            for k, found in zip(rows.tolist(), self._run(ids).tolist()):
                out[k] = found[:found.index(-1)] if found[-1] < 0 else found
        return out

    def _run(self, ids: np.ndarray) -> np.ndarray:
        ranks = np.column_stack([self.rank(ids[:, :-1], ids[:, 1:]), np.full(len(ids), self.none)])
        width, rows = np.arange(ids.shape[1]), np.arange(len(ids))
        while len(rows):
            part = ranks[rows]
            at = part.argmin(axis=1)
            low = part[np.arange(len(rows)), at]
            rows, at, low = (x[low < self.none] for x in (rows, at, low))
            # the token after the pair's first goes, and so does the pair's rank
            kept, later = ids[rows], width[None, :-1] > at[:, None]
            kept[:, :-1] = np.where(later, kept[:, 1:], kept[:, :-1])
            kept[:, -1] = -1
            each = np.arange(len(rows))
            kept[each, at] = low
            ids[rows] = kept
            moved = ranks[rows]
            moved[:, :-1] = np.where(later, moved[:, 1:], moved[:, :-1])
            moved[:, -1] = self.none
            inner = np.minimum(at + 1, len(width) - 1)
            moved[each, at] = np.where(at + 1 < len(width), self.rank(low, kept[each, inner]), self.none)
            first = np.flatnonzero(at > 0)
            moved[first, at[first] - 1] = self.rank(kept[first, at[first] - 1], low[first])
            ranks[rows] = moved
        return ids


class TreeDecoder:
    """Bytes of ids: both halves decoded and concatenated."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF_IDS):
        self.leaf = leaf
        size = max(ranks.values(), default=-1) + 1
        tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return gather(self.data, self.sizes, ids).tobytes()
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def send_file(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file along with the tasks; the name under which they find it."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _added(docs: DataFrame, name: str) -> T.StructType:
    if name in docs.columns:
        raise ValueError(f"the table already has a column {name}")
    return T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> Memo:
    """Ids by piece between blanks, for all tasks of a worker process."""
    import regex

    ranks, matches = read_ranks(path), regex.compile(pattern)
    tree, leaves = TreeEncoder(ranks), LeafEncoder(ranks)

    def encode_matches(found: list[bytes]) -> list[list[int]]:
        short = [m for m in found if len(m) <= LEAF and m not in ranks]
        ids = dict(zip(short, leaves.encode(short)))
        return [ids[m] if m in ids else tree.encode(m) for m in found]

    by_match = Memo(encode_matches, MATCHES)

    def encode(pieces: list[bytes]) -> list[list[int]]:
        split = [[m.encode() for m in matches.findall(p.decode())] for p in pieces]
        flat = list(dict.fromkeys(m for found in split for m in found))
        ids = dict(zip(flat, by_match.get(flat)))
        return [ids[found[0]] if len(found) == 1 else [i for m in found for i in ids[m]] for found in split]

    return Memo(encode, PIECES)


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of ``docs`` with ``ids``, the ids of ``text`` as little-endian 32-bit numbers.

    ``path`` is a rank file that the driver reads, ``pattern`` splits a text into matches that are
    encoded by themselves; special tokens are plain text. A null or empty text has no ids. Every row is
    encoded alone, so repeated rows and clashing names other than ``ids`` (refused) change nothing. A
    worker encodes distinct pieces between blanks and remembers a bounded number of them.
    """
    schema, name = _added(docs, "ids"), send_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _encoder(SparkFiles.get(name), pattern)
        for batch in slices(batches, "text"):
            found = chunks(batch.column("text"))
            if len(found.start):
                pieces, pick = found.distinct()
                ids = memo.get(pieces)
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                values = gather(np.array([i for x in ids for i in x], dtype="<u4"), sizes, pick)
                ends = np.concatenate([[0], np.cumsum(sizes[pick])])[np.concatenate([[0], np.cumsum(found.count)])]
            else:
                values, ends = np.zeros(0, dtype="<u4"), np.zeros(batch.num_rows + 1, dtype=np.int64)
            column = pa.Array.from_buffers(
                pa.binary(), batch.num_rows, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(values.tobytes())]
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, column], schema=pa.schema([*batch.schema, ("ids", pa.binary())]))

    return docs.mapInArrow(run, schema)


def decode_ids(docs: DataFrame, path: str) -> DataFrame:
    """All columns of ``docs`` with ``decoded``, the bytes of ``ids``; null ids stay null.

    An id outside the vocabulary fails the query. A column ``decoded`` is refused.
    """
    schema, name = _added(docs, "decoded"), send_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = TreeDecoder(read_ranks(SparkFiles.get(name)))
        for batch in slices(batches, "ids"):
            decoded = [
                None if x is None else decoder.decode(np.frombuffer(x, "<u4").astype(np.int64))
                for x in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(decoded, pa.binary())], schema=pa.schema([*batch.schema, ("decoded", pa.binary())])
            )

    return docs.mapInArrow(run, schema)
