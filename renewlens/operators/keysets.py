"""Set operations, samples and folds over keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewlens.operators.ladder import BUCKET_ROWS


def key_intersection(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.select(*key).intersect(b.select(*key))


def key_difference(a: DataFrame, *others: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that none of the others has."""
    out = a.select(*key).distinct()
    for other in others:
        out = out.join(other.select(*key), list(key), "left_anti")
    return out


def hash_order(key: str, seed: int) -> Column:
    """Reproducible pseudo-random order of keys, equal on every engine that has md5."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def sample_keys(df: DataFrame, key: str = "Co_Ref", n: int = 20, seed: int = 42) -> DataFrame:
    """``n`` distinct keys in hash order: a top-n per task, then one merge."""
    return (
        df.where(F.col(key).isNotNull())
        .select(key)
        .distinct()
        .orderBy(hash_order(key, seed), key)
        .limit(n)
    )


def stratified_folds(
    df: DataFrame, label: str, k: int, key: str | Sequence[str] = "Co_Ref", seed: int = 42,
    name: str = "fold",
) -> DataFrame:
    """Fold number 0..k-1 per labelled row; fold sizes differ by at most one within each label.

    ``key`` identifies a row, as (customer, year) does in the feature table.

    The exact round robin needs the position of each row within its label. Rows get a hash bucket
    first, positions are counted inside (label, bucket), and the bucket totals below are added. So a
    label with most of the rows is spread over all buckets instead of one window task. The number of buckets
    follows the number of rows. The input is read three times, so callers stage it first.
    """
    keys = [key] if isinstance(key, str) else list(key)
    spark = df.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    rows = df.withColumn("_h", F.md5(F.concat(text, F.lit(str(seed)))))
    # leading hex digits order the buckets the same way as the full hash
    prefix = F.conv(F.substring("_h", 1, 6), 16, 10).cast("bigint")
    rows = rows.withColumn("_b", F.floor(prefix * buckets / F.lit(16**6)).cast("int"))
    totals = rows.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    below = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        label, "_b", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy(label, "_b").orderBy("_h", *keys)
    return (
        rows.join(offsets, [label, "_b"])
        .withColumn(
            name, ((F.col("_off") + F.row_number().over(inside) - 1) % k).cast("int")
        )
        .drop("_h", "_b", "_off")
    )
