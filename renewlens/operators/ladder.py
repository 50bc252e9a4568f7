"""The score ladder: distinct values in ascending order with cumulative counts.

Rank tests, ROC and precision-recall curves, two-sample distances and exact quantiles all need counts
of rows at or below a value. A window over the whole table would put everything into one task. Here:

1. rows are reduced to one row per distinct value with its class counts (partial aggregation first)
   and staged, so the input is read exactly once;
2. cut points from a mergeable quantile sketch split the distinct values into ordered buckets. They
   only balance the work and never change the result, so a sketch is enough. One double per bucket
   reaches the driver, a million values to a bucket, and as literals the buckets are the same on
   every retry;
3. running sums inside a bucket and totals of the buckets below it add up to the global count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewlens.functions import scalars as fn
from renewlens.session import stage

#: Distinct values of one bucket, about; a bucket is one window group.
BUCKET_ROWS = 1_000_000


def cut_points(df: DataFrame, value: Column, buckets: int) -> list[float]:
    """At most ``buckets - 1`` increasing values that split the rows into about equal parts."""
    if buckets < 2:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(value, probs, max(1000, 10 * buckets))).first()[0]
    return sorted(set(cuts or []))


def score_ladder(
    df: DataFrame,
    value: str,
    counts: Mapping[str, Column],
    by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Per group and distinct value: ``n_<c>``, running ``cum_<c>`` and group total ``tot_<c>``.

    ``counts`` maps a class name to a 0/1 column. Rows without value or group are left out.
    """
    by = list(by)
    v = F.col(fn.quoted(value)).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v))
    for name in by:
        rows = rows.where(F.col(name).isNotNull())

    steps = stage(
        rows.groupBy(*by, v.alias("value")).agg(
            *[F.sum(c).cast("bigint").alias(f"n_{name}") for name, c in counts.items()]
        )
    )
    if buckets is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(partitions, -(-steps.count() // BUCKET_ROWS))
    cuts = cut_points(steps, F.col("value"), buckets)
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        steps = Bucketizer(splits=splits, inputCol="value", outputCol="_bucket").transform(steps)
    else:
        steps = steps.withColumn("_bucket", F.lit(0.0))

    # one row per group and bucket
    group = [F.col(c) for c in by] or [F.lit(0)]
    below = (
        Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*group)
    offsets = steps.groupBy(*by, "_bucket").agg(
        *[F.sum(f"n_{name}").alias(f"_s_{name}") for name in counts]
    )
    offsets = offsets.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_s_{n}").over(below), F.lit(0)).alias(f"_o_{n}") for n in counts],
        *[F.sum(f"_s_{n}").over(whole).alias(f"tot_{n}") for n in counts],
    )
    running = (
        Window.partitionBy(*by, "_bucket")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        steps.join(offsets, [*by, "_bucket"])
        .select(
            *by,
            "value",
            *[f"n_{name}" for name in counts],
            *[
                (F.sum(f"n_{name}").over(running) + F.col(f"_o_{name}")).alias(f"cum_{name}")
                for name in counts
            ],
            *[f"tot_{name}" for name in counts],
        )
    )


def class_ladder(
    df: DataFrame, value: str, label: str, by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Ladder with the counts of label 0 and label 1."""
    counts = {
        "0": fn.flag(F.col(label) == 0),
        "1": fn.flag(F.col(label) == 1),
    }
    labelled = df.where(F.col(label).isin(0, 1))
    return score_ladder(labelled, value, counts, by, buckets)


def quantiles_of_ladder(
    ladder: DataFrame, probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolation quantiles from a ladder that carries a count named ``all``."""
    at = {}
    for name, p in probs.items():
        position = (F.col("tot_all") - 1).cast("double") * F.lit(float(p))
        rank = F.floor(position)
        at[f"_lo_{name}"] = F.min(F.when(F.col("cum_all") > rank, F.col("value")))
        at[f"_hi_{name}"] = F.min(F.when(F.col("cum_all") > F.ceil(position), F.col("value")))
        at[f"_w_{name}"] = F.max(position - rank)
    picked = ladder.groupBy(*by).agg(
        F.max("tot_all").alias("n"), *[c.alias(name) for name, c in at.items()]
    )
    return picked.select(
        *by,
        "n",
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")
            ).alias(name)
            for name in probs
        ],
    )


def quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    approx: bool = False,
    accuracy: int = 10000,
) -> DataFrame:
    """Quantiles per group as columns named by ``probs``, plus the count ``n`` of values.

    Exact by default, through the ladder. ``approx=True`` uses the built-in sketch in one pass.
    """
    v = F.col(fn.quoted(value)).cast("double")
    if approx:
        rows = df.where(v.isNotNull() & ~F.isnan(v))
        return rows.groupBy(*by).agg(
            F.count("*").alias("n"),
            *[F.percentile_approx(v, p, accuracy).alias(name) for name, p in probs.items()],
        )
    ladder = score_ladder(df, value, {"all": F.lit(1)}, by)
    return quantiles_of_ladder(ladder, probs, by)
