"""Column handling shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shield(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Rename all columns but ``used`` so that an operator's own names are free.

    Returns the renamed table and a function that gives a result its old columns, in order.
    """
    names = {c: c if c in used else f"_x{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in names.items()))

    def restore(found: DataFrame) -> DataFrame:
        return found.select(*(F.col(x).alias(c) for c, x in names.items()))

    return inner, restore


def text_key() -> Column:
    """Fingerprint of a text; with doc_id it tells rows apart, and equal rows share it."""
    return F.xxhash64(F.col("text"))
