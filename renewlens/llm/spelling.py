"""Spelling variants: words one code point apart, found by Bloom filters over generated edits.

A word's edits are looked up in broadcast filters of the vocabulary, one set of filters for each
length. Only edits that a filter lets through are shuffled, to a join with the vocabulary itself.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.llm.text import Words, mix, slices
from renewlens.session import stage

#: Letters of words: lower-case a to z and U+00C0 to U+00FF (lead byte C3 and any second byte).
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
LEAD = 0xC3
#: Words have this many code points and occurrences at least.
MIN_LENGTH, MIN_COUNT = 5, 3
#: One in TYPO pairs of document and word loses a code point, as the contract of the query says.
TYPO = 97
#: Words of this length and longer share their filters.
LONGEST = 64
#: Words of one filter, bits of a filter for each word, bits set for one, bytes broadcast at once.
SHARD_WORDS, BITS, PROBES, ROUND_BYTES = 1 << 17, 24, 5, 32 << 20
#: Words whose edits one task generates.
TASK_WORDS = 20_000

_TABLE = np.zeros(256, dtype=np.uint8)
_TABLE[97:123] = _TABLE[65:91] = np.arange(97, 123, dtype=np.uint8)
_TABLE[LEAD] = LEAD
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & np.uint32(1), (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))
#: Longest run, in bytes, whose check sum is computed together with those of others.
_SIDE_BY_SIDE = 32
_PLACE, _LETTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def letter_runs(texts: pa.Array) -> Words:
    """Maximal runs of letters, with A to Z lower-cased; nulls have none."""
    n = len(texts)
    texts = texts.cast(pa.string()).fill_null("")
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays([0, n], texts), " ")
    total = int(lengths.sum()) + max(0, n - 1)
    raw = np.frombuffer(joined.buffers()[2], np.uint8, total) if total else np.zeros(0, np.uint8)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    data = _TABLE[raw]
    second = np.flatnonzero(data[:-1] == LEAD) + 1
    data[second] = raw[second]
    edge = np.diff((data != 0).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(data, data, first, start, end, np.diff(np.searchsorted(start, first)))


def check_sums(found: Words, prefixes: list[bytes]) -> np.ndarray:
    """CRC-32 of each run behind the prefix of its text; runs of like length advance together."""
    size = found.end - found.start
    state = np.repeat(np.array([zlib.crc32(p) for p in prefixes], dtype=np.uint32), found.count)
    order = np.argsort(-np.minimum(size, _SIDE_BY_SIDE + 1).astype(np.int16), kind="stable")
    at, size_of = found.start[order], size[order]
    from_here = int(np.searchsorted(-size_of.clip(max=_SIDE_BY_SIDE + 1), -_SIDE_BY_SIDE))
    c = ~state[order]
    for i in range(_SIDE_BY_SIDE):
        to = int(np.searchsorted(-size_of[from_here:], -i)) + from_here
        part = c[from_here:to]
        c[from_here:to] = _CRC[(part ^ found.data[at[from_here:to] + i]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(c)
    out[order] = ~c
    for k in order[:from_here]:
        out[k] = zlib.crc32(found.data[found.start[k]:found.end[k]].tobytes(), int(state[k]))
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        found = letter_runs(batch.column("text"))
        if not len(found.start):
            continue
        ids = batch.column("doc_id").cast(pa.string()).fill_null("").to_pylist()
        sums = check_sums(found, [f"{i}:".encode() for i in ids])
        hit = np.flatnonzero(sums % TYPO == 0)
        coded = found.arrow().dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False)
        n = np.bincount(np.delete(number, hit), minlength=len(coded.dictionary))
        changed: Counter[str] = Counter()
        for k, h in zip(hit.tolist(), sums[hit].tolist()):
            word = found.data[found.start[k]:found.end[k]].tobytes().decode()
            cut = h % len(word)
            changed[word[:cut] + word[cut + 1:]] += 1
        words = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array(list(changed), pa.string())])
        counts = np.concatenate([n, np.fromiter(changed.values(), np.int64, len(changed))]).astype(np.int64)
        good = pc.and_(pc.greater_equal(pc.utf8_length(words), MIN_LENGTH), pa.array(counts > 0))
        yield pa.RecordBatch.from_arrays([words, pa.array(counts)], names=["word", "n"]).filter(good)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) from doc_id and text: words of five code points that occur three times or more.

    A word is a run of letters, A to Z lower-cased, with one code point less where the check sum of
    document and run says so. A null text has no words, a null id stands for an empty string, repeated
    rows count each time, and other columns are not read. Every slice of text sends its distinct words.
    """
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counts = slim.mapInArrow(_count_batches, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# -- hashes of words and of their edits ---------------------------------------------------------


def _code_points(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)


def _terms(points: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What a code point at a place adds to the hash of its word."""
    return mix(points * _LETTER + places.astype(np.uint64) * _PLACE)


def _spread(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + np.uint64(length * int(_LETTER) % (1 << 64)))


def _mask(hashes: np.ndarray) -> np.ndarray:
    """The bits that a word sets in its 64-bit block."""
    bits = mix(hashes ^ _PLACE)
    out = np.zeros_like(bits)
    for k in range(PROBES):
        out |= np.uint64(1) << ((bits >> np.uint64(6 * k)) & np.uint64(63))
    return out


class Shards:
    """Which filter a hash belongs to: lengths, and slices of a length by the size of its vocabulary."""

    def __init__(self, sizes: dict[int, int], shard_words: int = SHARD_WORDS):
        self.first: dict[int, int] = {}
        self.split: dict[int, int] = {}
        self.blocks: list[int] = []
        for length, n in sorted(sizes.items()):
            many = -(-n // shard_words)
            self.first[length], self.split[length] = len(self.blocks), many
            self.blocks += [-(-n * BITS // (many * 64)) + 1] * many

    def shard(self, hashes: np.ndarray, length: int) -> np.ndarray:
        length = min(length, LONGEST)
        return self.first[length] + ((hashes >> np.uint64(48)) % np.uint64(self.split[length])).astype(np.int64)

    def block(self, hashes: np.ndarray, shard: np.ndarray) -> np.ndarray:
        blocks = np.array(self.blocks, dtype=np.uint64)[shard]
        return (((hashes & np.uint64(0xFFFFFFFF)) * blocks) >> np.uint64(32)).astype(np.int64)

    def rounds(self, limit: int) -> list[list[int]]:
        """Filters in order, in groups of at most ``limit`` bytes (one filter at least)."""
        out: list[list[int]] = []
        room = 0
        for k, blocks in enumerate(self.blocks):
            if not out or room < 8 * blocks:
                out.append([])
                room = limit
            out[-1].append(k)
            room -= 8 * blocks
        return out

    def lengths(self, shards: list[int]) -> set[int]:
        return {n for n, k in self.first.items() for s in shards if k <= s < k + self.split[n]}


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """(length, rows, words) of a batch, in pieces of about a million code points."""
    size = pc.utf8_length(batch.column("word")).to_numpy(zero_copy_only=False)
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        step = max(1, (1 << 20) // length)
        for at in range(0, len(rows), step):
            part = rows[at:at + step]
            yield length, part, batch.column("word").take(pa.array(part)).to_pylist()


def _hash_batches(shards: Shards):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, words in _by_length(batch):
                points = _code_points(words, length)
                hashes = _spread(_terms(points, np.arange(length)).sum(axis=1, dtype=np.uint64), length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards.shard(hashes, length)), pa.array(hashes.view(np.int64))], names=["shard", "hash"]
                )

    return run


def _build_filter(shards: Shards):
    """One filter; its group holds about SHARD_WORDS hashes whatever the size of the vocabulary."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        hashes = group.column("hash").to_numpy().view(np.uint64)
        bits = np.zeros(shards.blocks[shard], dtype=np.uint64)
        np.bitwise_or.at(bits, shards.block(hashes, np.full(len(hashes), shard)), _mask(hashes))
        return pa.table({"shard": pa.array([shard], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    return run


class Probe:
    """Edits of words against the filters of one round."""

    def __init__(self, shards: Shards, bits: dict[int, bytes]):
        self.shards = shards
        self.at = np.full(len(shards.blocks), -1, dtype=np.int64)
        parts, total = [], 0
        for k, data in bits.items():
            self.at[k] = total
            parts.append(np.frombuffer(data, np.uint64))
            total += len(parts[-1])
        self.bits = np.concatenate(parts)

    def has(self, length: int) -> bool:
        first = self.shards.first.get(min(length, LONGEST))
        return first is not None and bool((self.at[first:first + self.shards.split[min(length, LONGEST)]] >= 0).any())

    def test(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Numbers of the hashes that a filter of this round lets through."""
        shard = self.shards.shard(hashes, length)
        here = np.flatnonzero(self.at[shard] >= 0)
        hashes, shard = hashes[here], shard[here]
        mask = _mask(hashes)
        return here[self.bits[self.at[shard] + self.shards.block(hashes, shard)] & mask == mask]

    def edits(self, words: list[str], length: int) -> Iterator[tuple[int, str]]:
        """(row, edit) that pass: deletions, and replacements by a later letter.

        The other way of each link is found from the other word. Of a run of equal letters only the
        first is deleted, so no edit is made twice.
        """
        points = _code_points(words, length)
        places = np.arange(length)
        terms = _terms(points, places)
        if self.has(length):
            sums = terms.sum(axis=1, dtype=np.uint64)[:, None] - terms
            for letter in LETTERS:
                row, place = np.nonzero(points < letter)
                put = _terms(np.full(length, letter, dtype=np.uint64), places)
                for k in self.test(_spread(sums[row, place] + put[place], length), length).tolist():
                    w, i = words[row[k]], place[k]
                    yield int(row[k]), w[:i] + chr(letter) + w[i + 1:]
        if length > MIN_LENGTH and self.has(length - 1):
            before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
            moved = np.zeros_like(terms)
            moved[:, 1:] = _terms(points[:, 1:], places[:-1])
            after = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
            new = np.ones(points.shape, dtype=bool)
            new[:, 1:] = points[:, 1:] != points[:, :-1]
            row, place = np.nonzero(new)
            for k in self.test(_spread((before + after)[row, place], length - 1), length - 1).tolist():
                w, i = words[row[k]], place[k]
                yield int(row[k]), w[:i] + w[i + 1:]


def _probe_batches(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(*sent.value)
        for batch in batches:
            for length, rows, words in _by_length(batch):
                found = list(probe.edits(words, length))
                if found:
                    from_row = pa.array(rows[[r for r, _ in found]])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("word").take(from_row), batch.column("n").take(from_row), pa.array([e for _, e in found])],
                        names=["word", "n", "near"],
                    )

    return run


# -- links, forms and roots -----------------------------------------------------------------------


def near_words(
    vocab: DataFrame, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """(word, n, near, near_n): each pair of words one code point apart, once, from a staged (word, n).

    At most ``round_bytes`` of filters are collected and broadcast at a time. A larger vocabulary takes
    more rounds, each over the words whose edits can be in its filters. False positives go in the join.
    """
    spark = vocab.sparkSession
    length = F.least(F.char_length("word"), F.lit(LONGEST))
    sizes = {r["length"]: r["count"] for r in vocab.groupBy(length.alias("length")).count().collect()}
    shards = Shards(sizes, shard_words)
    hashed = vocab.select("word").mapInArrow(_hash_batches(shards), "shard long, hash long")
    filters = stage(hashed.groupBy("shard").applyInArrow(_build_filter(shards), "shard long, bits binary"))
    passed = None
    for numbers in shards.rounds(round_bytes):
        part = filters.where(F.col("shard").between(numbers[0], numbers[-1])).collect()
        sent = spark.sparkContext.broadcast((shards, {r["shard"]: r["bits"] for r in part}))
        wanted = shards.lengths(numbers)
        # class 64 stands for all longer words as well
        wanted |= {min(n + 1, LONGEST) for n in wanted}
        tasks = -(-sum(sizes.get(n, 0) for n in wanted) // TASK_WORDS)
        words = vocab.where(length.isin(sorted(wanted))).repartition(max(1, tasks), "word")
        found = stage(words.mapInArrow(_probe_batches(sent), "word string, n long, near string"))
        sent.destroy()
        passed = found if passed is None else passed.unionByName(found)
    if passed is None:
        return vocab.sparkSession.createDataFrame([], "word string, n long, near string, near_n long")
    exact = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return passed.join(exact, "near").select("word", "n", "near", "near_n")


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root): the end of each chain of forms, by doubling the steps taken.

    A form is at least twice as frequent, so no chain is longer than the logarithm of the highest count.
    """
    at = stage(forms.select("word", F.col("form").alias("root")))
    for _ in range(max(1, most.bit_length()).bit_length()):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = at.join(ahead, "root", "left")
        at = stage(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    return at.select("word", "root")


def spelling_variants(
    docs: DataFrame, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for the words of :func:`vocabulary`.

    ``n_near`` counts the words one inserted, deleted or replaced code point away. ``form`` is the most
    frequent of them (of equal ones the first by code point) if it occurs at least twice as often, else
    null; ``root`` is reached by following forms. No text, or none with frequent words, gives no rows.
    """
    vocab = stage(vocabulary(docs))
    links = stage(near_words(vocab, shard_words, round_bytes))
    mirrored = links.select(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")
    )
    alone = vocab.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    rows = alone.unionByName(links).unionByName(mirrored).groupBy("word").agg(
        F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best")
    )
    taken = -F.col("best.less") >= 2 * F.col("n")
    rows = stage(rows.select(
        "word", "n", "n_near", F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")
    ))
    most = rows.agg(F.max("n")).first()[0] or 0
    return rows.join(_roots(rows.where("form is not null"), most), "word", "left").withColumn("root", F.coalesce("root", "word"))
