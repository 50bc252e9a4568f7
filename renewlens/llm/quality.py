"""Quality rules: text statistics, and lines that many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renewlens.llm.frames import shield, text_key
from renewlens.llm.text import WORD, Words, count_words, lower_ascii, per_text, slices, words
from renewlens.session import stage

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Characters counted as symbols (fixed by the contract).
SYMBOLS = b"#*$%&|<>"

#: A line is boilerplate on a host if more documents than this hold it, whatever the size of the host.
MIN_DOCS = 20
#: A document is depleted if less than this share of its words stays.
MIN_LEFT = 0.30

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def _repeat_words(found: Words) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in it."""
    total = len(found.start)
    if total < 4:
        return np.zeros(len(found.count), dtype=np.int64)
    ids, n = found.ids()
    doc = found.doc
    # word numbers combine without loss: n**3 stays below 2**63 for slices of two million words
    gram = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    at = np.flatnonzero(doc[:-2] == doc[2:])
    order = at[np.lexsort((gram[at], doc[at]))]
    same = (gram[order[1:]] == gram[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(total, dtype=bool)
    for k in range(3):
        hit[order[twice] + k] = True
    return per_text(found, hit)


def _dup_lines(found: Words) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line."""
    n = len(found.count)
    breaks = np.flatnonzero(found.raw == 10)
    # a text ends at the blank after it
    cuts = np.sort(np.concatenate([breaks, found.first[1:] - 1]))
    starts = np.concatenate([[0], cuts[:-1] + 1])
    doc = np.searchsorted(found.first, starts, side="right") - 1
    with_word = np.searchsorted(found.start, cuts) > np.searchsorted(found.start, starts)
    keep = np.zeros(len(found.raw) + 1, dtype=bool)
    keep[: len(found.raw)] = True
    keep[cuts] = False
    lengths = cuts - starts
    if int(lengths.sum()) >= 1 << 31:
        raise ValueError("a text over 2 GB")
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    lines = pa.Array.from_buffers(
        pa.binary(), len(starts),
        [None, pa.py_buffer(offsets), pa.py_buffer(found.raw[keep[: len(found.raw)]])],
    )
    ids = pc.dictionary_encode(lines).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = doc[with_word] * np.int64(len(starts) + 1) + ids[with_word]
    distinct = np.unique(key) // np.int64(len(starts) + 1)
    return np.bincount(doc[with_word], minlength=n) - np.bincount(distinct, minlength=n)


def text_stats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the five counts of :data:`STATS`; a null text counts as empty."""
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = words(batch.column("text"))
            bounds = found.first

            def per_byte(mask: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(mask)])
                return sums[np.minimum(bounds[1:], len(mask))] - sums[bounds[:-1]]

            chars = (found.data != 0) & ((found.raw & 0xC0) != 0x80)
            counts = (
                found.count, per_byte(chars), per_byte(_SYMBOL[found.raw]),
                _dup_lines(found), _repeat_words(found),
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x, pa.int64()) for x in counts)], names=[*names, *STATS]
            )

    return docs.mapInArrow(run, schema)


def normal_line(line: Column) -> Column:
    """Lower-cased ASCII letters, digits as 0, runs of white space as one blank, trimmed."""
    line = F.translate(lower_ascii(line), "123456789", "000000000")
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def _host() -> Column:
    """Host of a document; documents without one share a host of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def _host_lines(docs: DataFrame, min_docs: int) -> DataFrame:
    """(host, tk, doc_id, line, first): lines that over ``min_docs`` documents of a host hold.

    The limit is the same at every size of a host. Documents are told by doc_id and text, so exact
    copies count one by one, from their numbers per text. doc_id is the smallest of a text, and
    ``first`` says that the document with it is the first of the host to hold the line.
    """
    keys = docs.where(F.col("text").isNotNull()).select("doc_id", _host().alias("host"), text_key().alias("tk"))
    sizes = keys.groupBy("host", "tk", "doc_id").agg(F.lit(1).alias("one")).groupBy("host", "tk").agg(F.sum("one").alias("n"))
    lines = docs.select("doc_id", _host().alias("host"), text_key().alias("tk"), F.explode(_lines(F.col("text"))).alias("line"))
    lines = lines.withColumn("line", F.xxhash64(normal_line(F.col("line"))))
    seen = stage(lines.groupBy("host", "line", "tk").agg(F.min("doc_id").alias("doc_id")).join(sizes, ["host", "tk"]))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")
    shared = (
        seen.groupBy("host", "line").agg(F.sum("n").alias("n_docs"), F.min(first).alias("first"))
        .where(F.col("n_docs") > min_docs).select("host", "line", F.col("first.tk").alias("first_tk"))
    )
    return seen.join(shared, ["host", "line"]).select(
        "host", "tk", "doc_id", "line", (F.col("tk") == F.col("first_tk")).alias("first")
    )


def base_failed() -> Column:
    """Short or repetitive text (thresholds fixed by the contract)."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _without(found: DataFrame) -> DataFrame:
    """``found`` with the lines of ``text`` whose hash in _lines is one of _gone cut out, without both columns.

    _lines holds a hash for each line of the text, null for a line without a word.
    """
    names = [c for c in found.columns if c not in ("_lines", "_gone")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            if batch.column("_lines").null_count < batch.num_rows:
                lines, gone, left = batch.column("_lines"), batch.column("_gone"), texts.to_pylist()
                for i in np.flatnonzero(pc.is_valid(lines).to_numpy(zero_copy_only=False)).tolist():
                    out = pc.is_in(lines[i].values, gone[i].values, skip_nulls=True).to_numpy(zero_copy_only=False)
                    left[i] = "\n".join([x for x, cut in zip(left[i].split("\n"), out.tolist()) if not cut])
                texts = pa.array(left, pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in names], names=names)

    return found.mapInArrow(run, found.select(*names).schema)


def cut_host_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """All columns of ``docs`` with the text counts, base_failed, words_left and kept.

    A line that over ``min_docs`` documents of a host hold is cut out of ``text`` in all of them but
    the first; words_left is the number of words then left. A document is kept if it passes the base
    rules and at least ``min_left`` of its words stay. A null or empty text fails the base rules.
    Columns of ``docs`` under the new names have to be shielded by the caller.
    """
    cut = _host_lines(docs, min_docs).groupBy("host", "tk").agg(
        F.first("doc_id").alias("_least"), F.collect_set("line").alias("_all"),
        F.collect_set(F.when(~F.col("first"), F.col("line"))).alias("_rest"),
    )
    stats = text_stats(docs.withColumns({"host": _host(), "tk": text_key()}))
    found = stats.join(cut, ["host", "tk"], "left").withColumn(
        "_gone", F.when(F.col("doc_id").eqNullSafe(F.col("_least")), F.col("_rest")).otherwise(F.col("_all"))
    ).drop("host", "tk", "_least", "_all", "_rest")
    some = F.size("_gone") > 0
    hashes = F.transform(F.split("text", "\n"), lambda x: F.when(x.rlike(WORD), F.xxhash64(normal_line(x))))
    left = _without(found.withColumn("_lines", F.when(some, hashes)))
    return (
        left.withColumn("words_left", count_words(F.col("text")))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= F.col("n_words") * F.lit(min_left)))
    )


def keep_clean(docs: DataFrame, **limits) -> DataFrame:
    """Documents that pass with their host's shared lines cut out, with the columns of ``docs``."""
    inner, restore = shield(docs, "doc_id", "text", "source")
    return restore(cut_host_lines(inner, **limits).where("kept"))
