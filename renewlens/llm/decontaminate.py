"""Benchmark decontamination: broadcast set of test n-grams against every token window of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renewlens.llm.frames import shield
from renewlens.llm.text import (
    BARE, BARE_WORD, Words, gram_hashes, inside_text, lower_ascii, slices, words,
)
from renewlens.session import stage

GRAM = 13
#: n-grams sent to the tasks at once, about 150 bytes each; more are worked off in blocks.
MAX_GRAMS = 500_000

HITS, ITEMS, WORDS = "_hits", "_items", "_n_words"
_FILTER_BITS = 20


def item_grams(bench: DataFrame, n: int = GRAM) -> DataFrame:
    """(gram, size, items): every n consecutive words of an item; a shorter item is one n-gram.

    Items without words have none. A null item_id is written as an empty string.
    """
    tokens = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(BARE_WORD), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("tokens") - (n - 1)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice("tokens", i, n), " "))
    return (
        bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), tokens.alias("tokens"))
        .where(F.size("tokens") > 0)
        .select("item", F.least(F.size("tokens"), F.lit(n)).alias("size"), F.explode(grams).alias("gram"))
        .groupBy("gram", "size")
        .agg(F.collect_set("item").alias("items"))
    )


class GramSet:
    """Hash set of n-grams: a bit filter, the hashes, and the words behind each hash."""

    def __init__(self, rows: list):
        self.items: dict[bytes, list[str]] = {r["gram"].encode(): list(r["items"]) for r in rows}
        by_size: dict[int, list[bytes]] = {}
        for r in rows:
            by_size.setdefault(r["size"], []).append(r["gram"].encode())
        self.sets = []
        for size, grams in sorted(by_size.items()):
            found = words(pa.array(b"".join([g, b" "]).decode() for g in grams), BARE)
            hashes = np.unique(gram_hashes(found.hashes(), size)[found.bounds[:-1]])
            seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
            seen[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.sets.append((size, hashes, seen))

    def search(self, found: Words) -> list[tuple[int, int, bytes]]:
        """(first word, end, gram) of every occurrence, words compared."""
        out = []
        word_hashes = found.hashes()
        for size, hashes, seen in self.sets:
            grams = gram_hashes(word_hashes, size)
            at = np.flatnonzero(seen[grams >> np.uint64(64 - _FILTER_BITS)] & inside_text(found, size))
            at = at[np.isin(grams[at], hashes)]
            for i in at.tolist():
                span = range(i, i + size)
                gram = b" ".join(found.data[found.start[j]:found.end[j]].tobytes() for j in span)
                if gram in self.items:
                    out.append((i, i + size, gram))
        return out


def _merge(ranges: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(ranges):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def _scan(docs: DataFrame, grams: list) -> DataFrame:
    """Add or extend the hit ranges and item ids of every document for one block of n-grams."""
    again = HITS in docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(grams)
    fields = docs.drop(HITS, ITEMS, WORDS).schema.fields
    names = [f.name for f in fields]
    schema = T.StructType([
        *fields, T.StructField(WORDS, T.LongType()), T.StructField(HITS, T.ArrayType(T.IntegerType())),
        T.StructField(ITEMS, T.ArrayType(T.StringType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = GramSet(sent.value)
        for batch in slices(batches, "text"):
            found = words(batch.column("text"), BARE)
            if again:
                ranges = [list(zip(x[::2], x[1::2])) for x in batch.column(HITS).to_pylist()]
                items = [set(x) for x in batch.column(ITEMS).to_pylist()]
            else:
                ranges = [[] for _ in range(batch.num_rows)]
                items = [set() for _ in range(batch.num_rows)]
            doc, bounds = found.doc, found.bounds
            for a, b, gram in known.search(found):
                d = doc[a]
                ranges[d].append((a - int(bounds[d]), b - int(bounds[d])))
                items[d].update(known.items[gram])
            columns = [batch.column(c) for c in names] + [
                pa.array(found.count, pa.int64()),
                pa.array([_merge(x) for x in ranges], pa.list_(pa.int32())),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, WORDS, HITS, ITEMS])

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, bench: DataFrame, n: int = GRAM, max_grams: int = MAX_GRAMS) -> DataFrame:
    """Documents with their hit word ranges, items and number of words.

    The set of n-grams goes to the tasks in blocks of about ``max_grams``; with more than one block
    the documents pass once per block, staged in between. Null texts have no words and no hits.
    """
    grams = item_grams(bench, n)
    total = grams.count()
    blocks = -(-total // max_grams) or 1
    for k in range(blocks):
        part = grams.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == k) if blocks > 1 else grams
        docs = _scan(docs, part.collect())
        if k + 1 < blocks:
            docs = stage(docs)
    return docs


def n_hit() -> Column:
    sign = F.transform(F.col(HITS), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(sign, F.lit(0).cast("long"), lambda s, x: s + x)


def verdicts(docs: DataFrame, bench: DataFrame, n: int = GRAM, max_grams: int = MAX_GRAMS) -> DataFrame:
    """All columns of ``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    A document is contaminated if at least a twentieth of its words, one at least, is hit. Columns of
    ``docs`` under these names are replaced.
    """
    new = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    found = find(docs.drop(*new, HITS, ITEMS, WORDS), bench, n, max_grams)
    hit = n_hit()
    return found.withColumns({
        "n_words": F.col(WORDS),
        "n_hit": hit,
        "n_items": F.size(ITEMS).cast("long"),
        "items_sha256": F.sha2(F.array_join(F.array_sort(ITEMS), ",").cast("binary"), 256),
        "contaminated": (hit > 0) & (20 * hit >= F.col(WORDS)),
    }).drop(WORDS)


def remove_documents(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """Documents that are not contaminated, with the columns of ``docs``."""
    inner, restore = shield(docs, "text")
    return restore(verdicts(inner, bench, **options).where(~F.col("contaminated")))


def remove_spans(docs: DataFrame, bench: DataFrame, n: int = GRAM, max_grams: int = MAX_GRAMS) -> DataFrame:
    """Documents with each run of hit words cut out of the text, columns as in ``docs``."""
    inner, restore = shield(docs, "text")
    found, names = find(inner, bench, n, max_grams), inner.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            split = words(batch.column("text"), BARE)
            texts = batch.column("text").to_pylist()
            for d, flat in enumerate(batch.column(HITS).to_pylist()):
                if not flat:
                    continue
                at, end = int(split.first[d]), int(split.first[d + 1]) - 1
                base, kept = int(split.bounds[d]), []
                for a, b in zip(flat[::2], flat[1::2]):
                    kept.append(split.raw[at:split.start[base + a]].tobytes())
                    at = int(split.end[base + b - 1])
                texts[d] = b"".join([*kept, split.raw[at:end].tobytes()]).decode()
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return restore(found.mapInArrow(run, inner.schema))
