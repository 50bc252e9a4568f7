"""Mixing sources to target weights: subset-sum budget fitting on document lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewlens.llm.frames import shield
from renewlens.llm.text import count_words
from renewlens.session import stage

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = 20240601
#: Words of a source's budget that the dynamic programme fits exactly; the rest goes by length shares.
FIT_WORDS = 1 << 16
#: Parts of a group of equally long documents of one source, so that no part is large.
SALTS = 512


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code-point order, null last, take the weights in turn. All words are dealt out by
    weight; a target stops at ``epochs`` times its source's size and the excess goes to the others by
    weight until none is above. Sorted by size per weight the stopped sources come first, so the
    final level follows from running sums.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(onward))
        # stopped if the level reached without it is above its cap
        .withColumn("stops", F.col("cap") * F.col("open") <= (F.col("total") - F.col("capped")) * F.col("weight"))
    )
    level = (
        F.max("total").over(everything) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(everything), F.lit(0))
    ).cast("double")
    free = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(level * F.col("weight") / free)
    return ranked.select("source", "source_size", target.alias("target"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, fit_words: int = FIT_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``budget``.

    The same share of every length first, rounded down; then long ones until at most ``fit_words``
    are open; then a bounded knapsack over what is left of each length. Ties take fewer words.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return counts.copy()
    taken[:] = [int(c) * budget // total for c in counts]
    taken[lengths == 0] = 0
    left, rest = counts - taken, budget - int((taken * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if rest <= fit_words or lengths[i] == 0:
            break
        t = min(int(left[i]), rest // int(lengths[i]), -(-(rest - fit_words) // int(lengths[i])))
        taken[i] += t
        left[i] -= t
        rest -= t * int(lengths[i])
    add = _knapsack(lengths, left, rest)
    return taken + add


def _knapsack(lengths: np.ndarray, counts: np.ndarray, rest: int) -> np.ndarray:
    """Counts whose words come nearest to ``rest``; each reached sum remembers the piece it came by."""
    out = np.zeros(len(lengths), dtype=np.int64)
    usable = np.flatnonzero((lengths > 0) & (counts > 0) & (lengths <= 2 * rest))
    if rest <= 0 or not len(usable):
        return out
    # a sum above twice the rest is worse than none
    size = min(2 * rest, rest + int(lengths[usable].max()))
    came = np.full(size + 1, -1, dtype=np.int64)
    came[0] = 0
    pieces: list[tuple[int, int]] = [(0, 0)]
    for i in usable[np.argsort(-lengths[usable], kind="stable")].tolist():
        many, unit = min(int(counts[i]), size // int(lengths[i])), 1
        while many > 0 and came[rest] < 0:
            k = min(unit, many)
            many, unit, w = many - k, unit * 2, k * int(lengths[i])
            if w > size:
                continue
            new = np.flatnonzero((came[: size + 1 - w] >= 0) & (came[w:] < 0)) + w
            came[new] = len(pieces)
            pieces.append((i, k))
    reached = np.flatnonzero(came >= 0)
    at = int(reached[np.argmin(np.abs(reached - rest))])
    while at > 0:
        i, k = pieces[came[at]]
        out[i] += k
        at -= k * int(lengths[i])
    return out


def _plans(source: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    whole = min(EPOCHS, int(round(target)) // size) if size else 0
    pdf = pdf.sort_values("size")
    extra = fit_lengths(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(round(target)) - whole * size if size else 0)
    return pdf.assign(whole=whole, extra=extra)[["source", "size", "source_size", "target", "whole", "extra"]]


def _row_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED
) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target and taken.

    taken is the number of words the mix takes of a document: its size times the passes over its
    source, and once more if it is chosen. Chosen are, for every source and length, as many documents
    as the fit asks for, by smallest seeded hash of id and text. Reruns agree; repeated rows count as
    documents of their own. A null text has size 0 and is never taken; a null source is a source.
    Columns of ``docs`` under the new names have to be shielded by the caller.
    """
    if epochs != EPOCHS:
        raise ValueError(f"only {EPOCHS} epochs are supported")
    sized = docs.withColumns({"size": count_words(F.col("text")), "_hash": _row_hash(seed)})
    sized = sized.withColumn("_salt", F.pmod("_hash", F.lit(SALTS)))
    cells = stage(sized.groupBy("source", "size", "_salt").agg(F.count(F.lit(1)).alias("n")))
    lengths = stage(cells.groupBy("source", "size").agg(F.sum("n").alias("n")))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = source_targets(sizes, weights, epochs)
    plans = (
        lengths.join(targets, lengths["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .groupBy("source")
        .applyInPandas(
            _plans,
            "source string, size long, source_size long, target double, whole int, extra long",
        )
    )
    before = Window.partitionBy("source", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    share = (
        cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(
            plans.select(F.col("source").alias("s"), F.col("size").alias("l"), "source_size", "target", "whole", "extra"),
            F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l")),
        )
        .select(
            "s", "l", F.col("_salt").alias("p"), "source_size", "target", "whole",
            F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias("quota"),
        )
    )
    chosen = Window.partitionBy("source", "size", "_salt").orderBy("_hash", "doc_id")
    found = sized.join(
        share,
        F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l")) & (F.col("_salt") == F.col("p")),
    )
    times = F.col("whole") + F.when(F.row_number().over(chosen) <= F.col("quota"), 1).otherwise(0)
    return found.withColumn("taken", (F.col("size") * times).cast("long")).drop(
        "s", "l", "p", "whole", "quota", "_hash", "_salt"
    )


MIX_COLUMNS = ("size", "source_size", "target", "taken")


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, with their columns and those of :data:`MIX_COLUMNS`.

    Columns of ``docs`` under the new names give way.
    """
    names = [c for c in docs.columns if c not in MIX_COLUMNS]
    inner, restore = shield(docs.select(*(f"`{c}`" for c in names)), "doc_id", "text", "source")
    found = mix(inner, **options).where(F.col("taken") > 0)
    back = dict(zip(inner.columns, names))
    return found.select(*(F.col(c).alias(back.get(c, c)) for c in (*inner.columns, *MIX_COLUMNS)))
