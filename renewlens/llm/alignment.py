"""Tokens of two tokenizers side by side: groups between common ends, overlaps, and how often they recur."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renewlens.llm.bpe_tree import send_file
from renewlens.llm.chunks import chunks, gather
from renewlens.llm.text import slices
from renewlens.session import stage

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The blank's stand-in in pieces, and the form of byte pieces (fixed values).
BLANK, BYTE = "▁", "<0x{:02X}>"
#: Bytes of text worked on at once, and pieces between blanks that are encoded in one text.
SLICE, TOGETHER = 2 << 20, 64
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def gallop(short: np.ndarray, long: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Place of the first number of ``long`` that is not below each of ``short``, from ``low`` on.

    Both lists ascend. All numbers of the shorter list gallop at once: steps double until they pass the
    number or the end, then a binary search looks inside the last step.
    """
    size, low = len(long), low.copy()
    high, going, step = low.copy(), np.arange(len(short)), 0
    while len(going):
        at = np.minimum(low[going] + step, size)
        passed = (at == size) | (long[np.minimum(at, size - 1)] >= short[going])
        high[going[passed]] = at[passed]
        low[going[~passed]] = at[~passed] + 1
        going, step = going[~passed], max(1, 2 * step)
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        below = long[middle] < short[going]
        low[going[below]] = middle[below] + 1
        high[going[~below]] = middle[~below]
        going = going[low[going] < high[going]]
    return low


def matched(
    ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``ends_a`` how many of ``ends_b`` lie below it, and whether it is among them.

    The shorter list drives. Both are cut into texts at the places ``starts``, 0 first, which have to
    fit; a number is looked for from the start of its text on.
    """
    if len(ends_a) <= len(ends_b):
        low = np.repeat(starts_b, np.diff(starts_a, append=len(ends_a)))
        rank = gallop(ends_a, ends_b, low)
        return rank, (rank < len(ends_b)) & (ends_b[np.minimum(rank, len(ends_b) - 1)] == ends_a)
    low = np.repeat(starts_a, np.diff(starts_b, append=len(ends_b)))
    place = gallop(ends_b, ends_a, low)
    same = (place < len(ends_a)) & (ends_a[np.minimum(place, len(ends_a) - 1)] == ends_b)
    # a number of the second list lies below all that come after its place, or after its equal
    below = np.bincount(place + same, minlength=len(ends_a) + 1)
    common = np.zeros(len(ends_a), dtype=bool)
    common[place[same]] = True
    return np.cumsum(below)[:len(ends_a)], common


@dataclass
class Aligned:
    """Alignment of several pieces, in order: what each has, and all their links and groups."""

    good: np.ndarray  # whether both tokenizers spell the piece
    counts: np.ndarray  # rows n_a, n_b, n_groups, n_links
    links: np.ndarray  # first id << 32 | second id
    sizes: np.ndarray  # bytes of each piece's groups as text, with an end sign after each group
    groups: np.ndarray


class TokenPair:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = byte_letters()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(BLANK in p.lstrip(BLANK) for p in names):
            raise ValueError("a piece goes on behind a blank, so texts can't be cut at blanks")
        plain = {BYTE.format(x): bytes([x]) for x in range(256)}
        self.bytes_b = [plain.get(p, p.replace(BLANK, " ").encode()) for p in names]
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            spelt = all(c in letters for c in token)
            self.bytes_a[i] = bytes(letters[c] for c in token) if spelt else token.encode()
        self.size_a, self.size_b = (np.array([len(t) for t in x]) for x in (self.bytes_a, self.bytes_b))
        # ids as text with the sign behind them: a comma inside a side, else a bar or the end of the group
        signs = [f"{i}{sign}".encode() for n, end in ((len(self.bytes_a), "|"), (len(names), ";")) for sign in "," + end for i in range(n)]
        self.text_sizes, self.text = np.array([len(x) for x in signs]), np.frombuffer(b"".join(signs), np.uint8)

    def encode(self, pieces: list[bytes], together: int = TOGETHER) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of runs of pieces, and which pieces are spelt by both; the other pieces are left out.

        Pieces that end without white space are encoded in one text with those behind them, which cuts
        them apart again.
        """
        last = [k for k, p in enumerate(pieces, 1) if k % together == 0 or p.decode()[-1].isspace()]
        bounds = sorted({0, *last, len(pieces)})
        runs = [b"".join(pieces[x:y]) for x, y in zip(bounds, bounds[1:])]
        texts = [r.decode() for r in runs]
        found_a = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        found_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        out_a, out_b, good = [], [], np.ones(len(pieces), dtype=bool)
        for x, y, run, a, b in zip(bounds, bounds[1:], runs, found_a, found_b):
            if b"".join([self.bytes_a[i] for i in a]) == run == b"".join([self.bytes_b[i] for i in b]):
                out_a.append(a)
                out_b.append(b)
            elif y - x == 1:
                good[x] = False
            else:
                more_a, more_b, good[x:y] = self.encode(pieces[x:y], 1)
                out_a += more_a
                out_b += more_b
        return out_a, out_b, good

    def align(self, pieces: list[bytes]) -> Aligned:
        """Alignment of pieces that start with a blank, which the second tokenizer adds itself."""
        runs_a, runs_b, good = self.encode(pieces)
        starts_a, starts_b = (np.cumsum([0, *map(len, runs)])[:-1] for runs in (runs_a, runs_b))
        a, b = (np.array([i for run in runs for i in run], dtype=np.int64) for runs in (runs_a, runs_b))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        rank, common = matched(ends_a, ends_b, starts_a, starts_b)
        # a first token meets the second ones from the rank of its start to that of its end
        low = np.concatenate([[0], (rank + common)[:-1]])[:len(a)]
        many = rank - low + 1
        meets = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        links = np.repeat(a, many) << 32 | b[meets]
        # places of the common ends slice both lists into groups, written one behind the other
        last_a = np.flatnonzero(common)
        last_b = rank[last_a]
        group_a = np.cumsum(common) - common
        group_b = np.searchsorted(last_b, np.arange(len(b)))
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]] = a + len(self.bytes_a) * common
        at_end = np.zeros(len(b), dtype=np.int64)
        at_end[last_b] = 1
        codes[np.arange(len(b)) + (last_a + 1)[group_b]] = 2 * len(self.bytes_a) + b + len(self.bytes_b) * at_end
        # every piece ends at a common end
        size = np.where(good, [len(p) for p in pieces], 0)
        ends = np.cumsum(size)
        to_a, to_b, to_group = (np.searchsorted(x, ends, "right") for x in (ends_a, ends_b, ends_a[last_a]))
        written = np.concatenate([[0], np.cumsum(self.text_sizes[codes])])
        sums = np.concatenate([[0], np.cumsum(many)])
        per_piece = [np.diff(x, prepend=0) for x in (to_a, to_b, to_group, sums[to_a], written[to_a + to_b])]
        return Aligned(good, np.array(per_piece[:4]), links, per_piece[4], gather(self.text, self.text_sizes, codes))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [x for x in range(256) if x not in prints]
    return {**{chr(x): x for x in prints}, **{chr(0x100 + k): x for k, x in enumerate(others)}}


@lru_cache(maxsize=1)
def _aligner(first: str, second: str) -> TokenPair:
    """The tokenizers, for all tasks of a worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TokenPair(first, second)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes: differences, their lowest bytes first, then the next ones."""
    small = np.diff(values, prepend=values.dtype.type(0)).astype("<i8")
    return pa.compress(small.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True) if len(values) else b""


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.int64)
    flat = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, n).T).reshape(-1).view("<i8"))


#: What a slice of documents keeps for the second pass: its link pairs with their counts, the pairs of
#: each piece, and the pieces of each document with theirs; the lengths unpack them.
PACKED = ("pairs", "totals", "piece_ends", "piece_pairs", "doc_ends", "doc_pieces", "doc_times")


def _align_slices(files: tuple[str, str], schema: T.StructType):
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _aligner(*map(SparkFiles.get, files))
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, "text", SLICE)):
            texts, n = batch.column("text"), batch.num_rows
            found = chunks(texts, " ")
            pieces, pick = found.distinct()
            aligned = pair.align(pieces)
            doc = np.repeat(np.arange(n), found.count)
            good = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False).copy()
            good[doc[~aligned.good[pick]]] = False
            keep = good[doc]
            doc, pick = doc[keep], pick[keep]
            # the common ends of a text are those of its pieces, so counts add up and groups follow each other
            sums = [np.bincount(doc, values[pick], n).astype(np.int64) for values in aligned.counts]
            written = gather(aligned.groups, aligned.sizes, pick)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, aligned.sizes[pick], n))]).astype(np.int32)
            groups = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(bounds), pa.py_buffer(written.tobytes())])
            # distinct pieces of the documents that count, and how often each stands in which document
            seen, times = np.unique(doc * max(1, len(pieces)) + pick, return_counts=True)
            pairs, piece_pairs = np.unique(aligned.links, return_inverse=True)
            per_piece = np.bincount(pick, minlength=len(pieces))
            totals = np.bincount(piece_pairs, np.repeat(per_piece, aligned.counts[3]), len(pairs)).astype(np.int64)
            packed = (
                pairs, totals, np.cumsum(aligned.counts[3]), piece_pairs,
                np.cumsum(np.bincount(seen // max(1, len(pieces)), minlength=n)), seen % max(1, len(pieces)), times,
            )
            first = [pack(np.asarray(x, dtype=np.int64)) for x in packed]
            columns = {
                "slice": pa.array([part << 33 | number] * n, pa.int64()), "row": pa.array(range(n), pa.int32()),
                "doc_id": batch.column("doc_id"), **{c: pa.array(x) for c, x in zip(COUNTS, sums)},
                "groups": pc.utf8_rtrim(groups, ";"),
                "sizes": pa.array([[len(x) for x in packed]] + [None] * (n - 1), pa.list_(pa.int64())),
                **{c: pa.array([x] + [None] * (n - 1), pa.binary()) for c, x in zip(PACKED, first)},
            }
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return run


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each link pair of each slice."""
    for batch in batches:
        for row in batch.to_pylist():
            pairs, totals = (unpack(row[c], row["sizes"][k]) for k, c in enumerate(("pairs", "totals")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pairs), row["slice"])), pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(pairs), pa.array(totals)],
                names=["slice", "place", "pair", "n"],
            )


def _score_slice(names: list[str]):
    """Add up the counts of the pairs over the links of each document of one slice."""

    def run(docs: pa.Table, counted: pa.Table) -> pa.Table:
        docs = docs.sort_by("row").combine_chunks()
        n = docs.num_rows
        head = docs.slice(0, 1).to_pylist()[0]
        data = {c: unpack(head[c], k) for c, k in zip(PACKED, head["sizes"])}
        count, best = np.zeros((2, len(data["pairs"])), dtype=np.int64)
        place = counted.column("place").to_numpy()
        count[place] = counted.column("count").to_numpy()
        best[place] = counted.column("best").to_numpy()
        doc = np.repeat(np.arange(n), np.diff(data["doc_ends"], prepend=0))
        out = {}
        for name, value in (("n_best", best), ("count_sum", count)):
            sums = np.concatenate([[0], np.cumsum(value[data["piece_pairs"]])])
            per_piece = np.diff(sums[data["piece_ends"]], prepend=0)
            total = np.zeros(n, dtype=np.int64)
            np.add.at(total, doc, per_piece[data["doc_pieces"]] * data["doc_times"])
            out[name] = total
        return pa.table({c: pa.array(out[c]) if c in out else docs.column(c) for c in names})

    return run


def align(docs: DataFrame, first: str, second: str, keep: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """Alignment of the texts of (doc_id, text) under two tokenizers; one row for each row of ``docs``.

    ``first`` is a byte-level BPE file, ``second`` a piece model; both read a blank and the text. The
    result has doc_id, n_a and n_b (tokens), n_groups and ``groups`` (tokens between common ends,
    ``a1,a2|b1;a3|b2``), n_links (pairs of tokens that overlap), and over the links n_best (those whose
    pair is the most frequent of its second token) and count_sum (occurrences of the pair in all texts).
    ``keep`` says what is kept of the groups. A null or empty text, and one whose tokens don't spell it,
    has zeros and no groups. Other columns of ``docs`` are not read; repeated rows count each time.

    Texts are cut at blanks where tokens of both must end, so the common ends of a text are those of its
    pieces. The counts of pairs go back to slices of documents by a join; nothing is broadcast.
    """
    spark = docs.sparkSession
    files = (send_file(spark, first), send_file(spark, second))
    slim = docs.select("doc_id", "text")
    long, binary = T.LongType(), T.BinaryType()
    fields = [("slice", long), ("row", T.IntegerType()), ("doc_id", slim.schema["doc_id"].dataType)]
    fields += [(c, long) for c in COUNTS] + [("groups", T.StringType()), ("sizes", T.ArrayType(long))]
    schema = T.StructType([T.StructField(*f) for f in fields + [(c, binary) for c in PACKED]])
    aligned = stage(slim.mapInArrow(_align_slices(files, schema), schema).withColumn("groups", keep(F.col("groups"))))
    heads = aligned.where("row = 0").select("slice", "sizes", "pairs", "totals")
    rows = stage(heads.mapInArrow(_pair_rows, "slice long, place int, pair long, n long"))
    counts = stage(rows.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    judged = counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    back = rows.select("slice", "place", "pair").join(judged, "pair").select("slice", "place", "count", "best")
    names = ["doc_id", *COUNTS, "groups", "n_best", "count_sum"]
    result = T.StructType([
        *(aligned.schema[c] for c in names[:-2]), *(T.StructField(c, long) for c in names[-2:])
    ])
    return aligned.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(_score_slice(names), result)
