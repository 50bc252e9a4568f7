"""Line dedup on content-defined chunks of lines, in built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.llm.frames import shield, text_key
from renewlens.llm.text import WORD
from renewlens.session import stage, stage_counted

#: A chunk ends after about every DIVISOR-th line; a chunk of fewer than MIN_LINES lines stays.
DIVISOR, MIN_LINES = 3, 2
#: Base and modulus of the rolling hash over two line hashes (below 2**31, so products fit a long).
ROLL, MODULUS = 1_000_003, 2_147_483_647


def line_hash(line: Column) -> Column:
    """32 bits of the digest of a line."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long") % MODULUS


def ends(hashes: Column) -> Column:
    """Numbers of the lines after which a chunk ends, from 1; the last line is one.

    The hash rolls over a line and the one before, so an inserted or removed line moves no boundary
    but its neighbours'.
    """
    roll = lambda i: (F.element_at(hashes, i - 1) * ROLL + F.element_at(hashes, i)) % MODULUS
    size = F.size(hashes)
    inner = F.filter(
        F.when(size > 2, F.sequence(F.lit(2), size - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: roll(i) % DIVISOR == 0,
    )
    return F.concat(inner, F.array(size))


def chunks(docs: DataFrame) -> DataFrame:
    """Add ``lines``, ``ends`` and ``starts`` of the chunks of each text; a null text has no lines."""
    lines = F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))
    hashed = docs.withColumn("lines", lines).withColumn("_h", F.transform("lines", line_hash))
    cut = hashed.withColumn("ends", F.when(F.size("lines") > 0, ends(F.col("_h"))).otherwise(F.array().cast("array<int>")))
    starts = F.transform(
        "ends", lambda e, k: F.when(k == 0, F.lit(1)).otherwise(F.element_at("ends", F.greatest(k, F.lit(1))) + 1)
    )
    return cut.withColumn("starts", starts).drop("_h")


def _joined(lines: Column, r: Column) -> Column:
    """The text of a range of lines."""
    return F.array_join(F.slice(lines, r["at"], r["until"] - r["at"] + 1), "\n")


def _occurrences(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, tk, at, until): the multi-line chunks with a line that is not blank."""
    ranges = F.transform(F.arrays_zip("starts", "ends"), lambda r: F.struct(r["starts"].alias("at"), r["ends"].alias("until")))
    many = F.filter(ranges, lambda r: r["until"] - r["at"] >= MIN_LINES - 1)
    rows = chunks(docs).select("doc_id", "tk", "lines", F.explode(many).alias("r"))
    text = _joined(F.col("lines"), F.col("r"))
    return rows.where(text.rlike(WORD)).select(F.xxhash64(text).alias("hash"), "doc_id", "tk", "r.at", "r.until")


def _pairs(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, tk, at, until): all pairs of adjacent lines of which one at least is not blank."""
    lines = F.split("text", "\n")
    pairs = F.arrays_zip(lines.alias("a"), F.slice(lines, 2, F.size(lines)).alias("b"))
    rows = docs.where("text is not null").select("doc_id", "tk", F.posexplode(pairs).alias("i", "p"))
    rows = rows.where("p.b is not null").where(F.col("p.a").rlike(WORD) | F.col("p.b").rlike(WORD))
    at = F.col("i") + 1
    return rows.select(
        F.xxhash64(F.col("p.a"), F.col("p.b")).alias("hash"), "doc_id", "tk", at.alias("at"), (at + 1).alias("until")
    )


def _place() -> Column:
    """Order of the occurrences of a chunk; the first one stays."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk", "at")


def _is_copy() -> Column:
    """Whether an occurrence stands after ``first`` and does not overlap it."""
    inside = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tk") == F.col("first.tk"))
    return (_place() != F.col("first")) & ~(inside & (F.col("at") == F.col("first.at") + 1))


def _for_doc(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join per-document results by doc_id (null meets null) and fingerprint.

    The results grow with the corpus, so they are merged and never broadcast.
    """
    found = found.withColumnsRenamed({"doc_id": "_id", "tk": "_tk"})
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk"))
    return docs.join(found.hint("merge"), on, how).drop("_id", "_tk")


def _by_bytes(docs: DataFrame, hits: DataFrame, clash: DataFrame) -> DataFrame:
    """``hits`` under the hashes of ``clash``, with copies told by the bytes of their lines."""
    apart = hits.join(clash, "hash", "left_semi").drop("copy")
    ranges = apart.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("hash", "at", "until")).alias("r"))
    rows = _for_doc(docs, ranges, "inner").select("doc_id", "tk", F.split("text", "\n").alias("lines"), F.explode("r").alias("r"))
    texts = stage(rows.select("r.hash", "doc_id", "tk", "r.at", "r.until", _joined(F.col("lines"), F.col("r")).alias("chunk")))
    firsts = texts.groupBy("hash", "chunk").agg(F.min(_place()).alias("first"))
    return texts.join(firsts, ["hash", "chunk"]).withColumn("copy", _is_copy()).select(*hits.columns)


def repeated(docs: DataFrame, occurrences: Callable[[DataFrame], DataFrame] = _occurrences) -> DataFrame:
    """(doc_id, tk, cuts): line ranges of chunks that stand earlier in the corpus, from doc_id, tk, text.

    Chunks meet by hash. Those whose hash comes again are fetched as text, and the different texts
    under a hash are counted: one makes all its occurrences copies, several are told apart by their
    bytes. Of equal chunks the first stays: smallest doc_id (nulls last), fingerprint, line.
    ``occurrences`` gives the chunks; a pair of lines that shares a line with the first one is no copy.
    """
    seen = stage(occurrences(docs))
    often = seen.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("first")).where("n > 1").drop("n")
    # merged at every size: these grow with the corpus like the per-document results
    hits = stage(
        seen.join(often.hint("merge"), "hash").select("hash", "doc_id", "tk", "at", "until", _is_copy().alias("copy"))
    )
    again = hits.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("hash", "at", "until")).alias("again"))
    fetched = _for_doc(docs, again, "inner").select(F.split("text", "\n").alias("lines"), F.explode("again").alias("r"))
    texts = fetched.select("r.hash", _joined(F.col("lines"), F.col("r")).alias("chunk")).distinct()
    clash, n = stage_counted(texts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("hash"))
    if n:
        hits = hits.join(clash, "hash", "left_anti").unionByName(_by_bytes(docs, hits, clash))
    return hits.where("copy").groupBy("doc_id", "tk").agg(F.collect_set(F.struct("at", "until")).alias("cuts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, with ``text`` left without repeated chunks and three counts added.

    n_lines, n_chunks and n_removed_lines count the lines and chunks of the text and the lines taken
    out. A null text stays null with no lines. Rows with equal id and text are one document and are
    treated alike. Columns of ``docs`` under these names have to be shielded by the caller.
    """
    keyed = docs.withColumn("tk", text_key())
    cuts = stage(repeated(keyed.select("doc_id", "tk", "text")))
    found = chunks(_for_doc(keyed, cuts, "left"))
    gone = F.flatten(F.transform("cuts", lambda c: F.sequence(c["at"], c["until"])))
    stays = F.array_except(F.sequence(F.lit(1), F.size("lines")), gone)
    left = F.array_join(F.transform(stays, lambda i: F.element_at("lines", i)), "\n")
    return found.withColumns({
        "n_lines": F.size("lines").cast("long"),
        "n_chunks": F.size("ends").cast("long"),
        "n_removed_lines": F.when(F.col("cuts").isNull(), 0).otherwise(F.size(gone)).cast("long"),
        "text": F.when(F.col("cuts").isNull(), F.col("text")).otherwise(left),
    }).drop("tk", "cuts", "lines", "starts", "ends")


def _beyond(cuts: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Occurrences of pairs of adjacent lines, but for those inside the repeated chunks ``cuts``."""
    inner = cuts.select(
        F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), F.explode("cuts").alias("c")
    ).select("_id", "_tk", F.explode(F.sequence(F.col("c.at"), F.col("c.until") - 1)).alias("_at"))

    def occurrences(docs: DataFrame) -> DataFrame:
        on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")) & (F.col("at") == F.col("_at"))
        return _pairs(docs).join(inner.hint("merge"), on, "left_anti")

    return occurrences


def dedup_runs(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, with ``text`` left without repeated runs of lines and two counts added.

    A run of two or more lines is repeated if its lines stand in the same order, with nothing between
    them, earlier in the corpus; a line goes if a pair of adjacent lines over it stands earlier, which
    is the same, since each pair of a repeated run does. A pair of blank lines alone is no run.

    Content-defined chunks are compared first. What is left to compare is pairs of lines: those inside
    first or single chunks and those over a boundary. They grow the repeated chunks to whole runs and
    find runs without a chunk of their own. Pairs inside a repeated chunk need no comparison, since
    the first chunk of its text has them too, so a passage copied whole is compared as chunks alone.
    Counts, nulls and equal rows are as in :func:`dedup_lines`.
    """
    keyed = docs.withColumn("tk", text_key())
    slim = keyed.select("doc_id", "tk", "text")
    whole = stage(repeated(slim))
    rest = stage(repeated(slim, _beyond(whole)))
    cuts = whole.unionByName(rest).groupBy("doc_id", "tk").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    lines = F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))
    found = _for_doc(keyed, cuts, "left").withColumn("lines", lines)
    found = found.withColumn("full", F.transform("lines", lambda x: x.rlike(WORD)))
    pairs = F.flatten(F.transform("cuts", lambda c: F.sequence(c["at"], c["until"] - 1)))
    pairs = F.filter(pairs, lambda i: F.element_at("full", i) | F.element_at("full", i + 1))
    gone = F.array_distinct(F.flatten(F.transform(pairs, lambda i: F.array(i, i + 1))))
    found = found.withColumn("gone", F.coalesce(gone, F.array().cast("array<int>")))
    stays = F.array_except(F.sequence(F.lit(1), F.size("lines")), F.col("gone"))
    left = F.array_join(F.transform(stays, lambda i: F.element_at("lines", i)), "\n")
    return found.withColumns({
        "n_lines": F.size("lines").cast("long"),
        "n_removed_lines": F.size("gone").cast("long"),
        "text": F.when(F.size("gone") == 0, F.col("text")).otherwise(left),
    }).drop("tk", "cuts", "lines", "full", "gone")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Documents without repeated runs of lines, with the columns of ``docs``.

    A document that had words and is left without any goes: all its lines stand in earlier documents.
    """
    inner, restore = shield(docs, "doc_id", "text")
    found = dedup_runs(inner)
    emptied = (F.col("n_removed_lines") > 0) & ~F.col("text").rlike(WORD)
    return restore(found.where(~F.coalesce(emptied, F.lit(False))))
