"""Stored sketches of keys and values, mergeable over groups, years and later loads.

The exact operators stay the default. A sketch is a small binary column next to its group; tables of
them are kept, and unions, overlaps and quantiles of any set of groups are read from them without a
pass over the events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 ** KEY_SIZE entries: distinct counts are exact below that many keys, beyond it the standard error is
#: about 1 / sqrt(2 ** KEY_SIZE), 0.8 %. VALUE_SIZE 400 keeps ranks within about 1 %.
KEY_SIZE, VALUE_SIZE = 14, 400
KEYS, VALUES, ROWS = "key_sketch", "value_sketch", "n_rows"


def key_sketches(df: DataFrame, by: Sequence[str], key: str = "Co_Ref", size: int = KEY_SIZE) -> DataFrame:
    """(group, n_rows, key_sketch): rows and a theta sketch of the distinct keys of each group.

    Partial sketches are made before the shuffle. A null key is in no sketch, but its row counts.
    """
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(ROWS), F.theta_sketch_agg(key, size).alias(KEYS))


def merge_keys(sketches: DataFrame, by: Sequence[str] = (), size: int = KEY_SIZE) -> DataFrame:
    """Sketches of coarser groups; without ``by`` one row for all."""
    return sketches.groupBy(*by).agg(F.sum(ROWS).alias(ROWS), F.theta_union_agg(KEYS, size).alias(KEYS))


def distinct_keys(sketch: str | Column = KEYS) -> Column:
    return F.theta_sketch_estimate(sketch)


def sketched_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """:func:`~renewlens.operators.profiling.key_overlap` of two one-row tables from :func:`merge_keys`.

    The error of the common keys is relative to the larger side.
    """
    both = a.select(F.col(KEYS).alias("_a")).join(b.select(F.col(KEYS).alias("_b")))  # one row each
    n_b = F.theta_sketch_estimate("_b")
    n_both = F.theta_sketch_estimate(F.theta_intersection("_a", "_b"))
    return both.select(
        F.theta_sketch_estimate("_a").alias("n_a"), n_b.alias("n_b"), n_both.alias("n_both"),
        (F.try_divide(n_both.cast("double"), n_b) * 100).alias("coverage_pct"),
    )


def value_sketches(df: DataFrame, by: Sequence[str], value: str, size: int = VALUE_SIZE) -> DataFrame:
    """(group, n_rows, value_sketch): a KLL sketch of the values of each group; nulls are left out."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias(ROWS), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias(VALUES)
    )


def merge_values(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sketches.groupBy(*by).agg(F.sum(ROWS).alias(ROWS), F.kll_merge_agg_double(VALUES).alias(VALUES))


def sketched_quantile(q: float, sketch: str | Column = VALUES) -> Column:
    """The value at a share of the ranks."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))
