"""Hypothesis and drift tests. Spark reduces the data; only one row per test gets a p-value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.functions import scalars as fn
from renewlens.functions.pvalues import chi2_p_value, kolmogorov_p, normal_two_sided_p
from renewlens.operators.ladder import score_ladder

ALPHA = 0.05
DRIFT_ALPHA = 0.01


def _long(df: DataFrame, features: Sequence[str], keep: Sequence[str], dtype: str) -> DataFrame:
    cast = df.select(*keep, *[F.col(fn.quoted(c)).cast(dtype).alias(c) for c in features])
    return cast.unpivot(list(keep), list(features), "feature", "value")


def chi_square_tests(
    df: DataFrame, features: Sequence[str], label: str = "churn_label"
) -> DataFrame:
    """Independence of each categorical feature and a 0/1 label, one row per feature.

    With one degree of freedom the continuity correction is applied. ``cramers_v`` divides by all
    rows of the input; it is null when either side has a single level.
    """
    # every row counts towards n_rows; a row without value or label enters no cell
    y = F.col(label)
    long = _long(df, features, [label], "string")
    known = F.col("value").isNotNull() & y.isin(0, 1)
    levels = long.groupBy("feature", "value").agg(
        F.count("*").alias("rows"),
        F.count_if(known & (y == 0)).alias("n0"),
        F.count_if(known & (y == 1)).alias("n1"),
    )
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    level_n = n0 + n1
    per_feature = levels.groupBy("feature").agg(
        F.sum("rows").alias("n_rows"),
        F.count_if(level_n > 0).alias("levels"),
        F.sum(n0).alias("t0"),
        F.sum(n1).alias("t1"),
        F.sum(F.try_divide(n0 * n0, level_n)).alias("q0"),
        F.sum(F.try_divide(n1 * n1, level_n)).alias("q1"),
        # any one level stands for a 2 x 2 table: all four deviations are equal in size
        F.min(F.when(level_n > 0, F.struct("value", "n0", "n1"))).alias("one"),
    )
    n = F.col("t0") + F.col("t1")
    classes = fn.flag(F.col("t0") > 0) + fn.flag(F.col("t1") > 0)
    smaller = F.least(F.col("levels"), classes)
    plain = n * (
        F.coalesce(F.try_divide(F.col("q0"), F.col("t0")), F.lit(0.0))
        + F.coalesce(F.try_divide(F.col("q1"), F.col("t1")), F.lit(0.0))
        - 1.0
    )
    one_n = (F.col("one.n0") + F.col("one.n1")).cast("double")
    deviation = F.abs(F.col("one.n0") - one_n * F.col("t0") / n)
    inverse_expected = F.try_divide(n * n * n, one_n * (n - one_n) * F.col("t0") * F.col("t1"))
    corrected = F.pow(F.greatest(deviation - 0.5, F.lit(0.0)), F.lit(2.0)) * inverse_expected
    out = per_feature.select(
        "feature",
        "n_rows",
        ((F.col("levels") - 1) * (classes - 1)).cast("int").alias("dof"),
        smaller.alias("_smaller"),
        F.when((F.col("levels") == 2) & (classes == 2), corrected)
        .when((smaller <= 1), F.lit(0.0))
        .otherwise(F.greatest(plain, F.lit(0.0)))
        .alias("chi2"),
    )
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n_rows") * (F.col("_smaller") - 1)))
    return out.select(
        "feature",
        "n_rows",
        "chi2",
        "dof",
        chi2_p_value("chi2", "dof").alias("p_value"),
        F.when(F.col("_smaller") > 1, v).alias("cramers_v"),
    ).withColumn("significant", F.col("p_value") < ALPHA)


def chi_square_test(df: DataFrame, feature: str, label: str = "churn_label") -> DataFrame:
    return chi_square_tests(df, [feature], label)


def cramers_v(df: DataFrame, feature: str, label: str = "churn_label") -> DataFrame:
    return chi_square_tests(df, [feature], label).select("feature", "cramers_v")


def _two_class_ladder(
    df: DataFrame, features: Sequence[str], label: str
) -> DataFrame:
    long = _long(df, features, [label], "double").where(F.col(label).isin(0, 1))
    counts = {"0": fn.flag(F.col(label) == 0), "1": fn.flag(F.col(label) == 1)}
    return score_ladder(long, "value", counts, by=["feature"])


def mann_whitney_tests(
    df: DataFrame, features: Sequence[str], label: str = "churn_label"
) -> DataFrame:
    """Rank-sum test of label 0 against label 1, one row per feature.

    ``u_statistic`` counts the pairs in which the label-0 value is larger, ties as half. The p-value
    is the normal approximation with tie and continuity correction; a feature without values has none; ``effect_size_r`` is abs(z)/sqrt(n)
    with z taken without tie correction.
    """
    ladder = _two_class_ladder(df, features, label)
    a, b = F.col("n_0").cast("double"), F.col("n_1").cast("double")
    t = a + b
    value = F.col("value")
    sums = ladder.groupBy("feature").agg(
        F.max("tot_0").cast("double").alias("n0"),
        F.max("tot_1").cast("double").alias("n1"),
        F.sum(a * (F.col("cum_1") - b / 2.0)).alias("u"),
        F.sum(t * t * t - t).alias("ties"),
        F.sum(a * value).alias("s0"),
        F.sum(b * value).alias("s1"),
    )
    n0, n1, u = F.col("n0"), F.col("n1"), F.col("u")
    n = n0 + n1
    middle = n0 * n1 / 2.0
    plain_sd = F.sqrt(n0 * n1 * (n + 1.0) / 12.0)
    tie_sd = F.sqrt(
        n0 * n1 / 12.0 * (n + 1.0 - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1.0)), F.lit(0.0)))
    )
    z = F.try_divide(F.greatest(u, n0 * n1 - u) - middle - 0.5, tie_sd)
    stats = sums.select(
        "feature",
        n0.cast("bigint").alias("n_0"),
        n1.cast("bigint").alias("n_1"),
        u.alias("u_statistic"),
        z.alias("z"),
        F.try_divide(F.abs(F.try_divide(u - middle, plain_sd)), F.sqrt(n)).alias("effect_size_r"),
        F.try_divide(F.col("s0"), n0).alias("mean_0"),
        F.try_divide(F.col("s1"), n1).alias("mean_1"),
    )
    return _every_feature(stats, features, ["n_0", "n_1"]).select(
        "*", normal_two_sided_p("z").alias("p_value")
    ).withColumn("significant", F.col("p_value") < ALPHA)


def mann_whitney_test(df: DataFrame, feature: str, label: str = "churn_label") -> DataFrame:
    return mann_whitney_tests(df, [feature], label)


def _every_feature(stats: DataFrame, features: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """A row for every feature: one without values has counts of 0 and no statistics."""
    listed = stats.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    return listed.join(stats, "feature", "left").fillna(0, subset=list(counts)).select(*stats.columns)


def _ks(ladder: DataFrame, features: Sequence[str]) -> DataFrame:
    f0 = F.try_divide(F.col("cum_0").cast("double"), F.col("tot_0"))
    f1 = F.try_divide(F.col("cum_1").cast("double"), F.col("tot_1"))
    value = F.col("value")
    stats = ladder.groupBy("feature").agg(
        F.max("tot_0").alias("n_a"),
        F.max("tot_1").alias("n_b"),
        F.max(F.abs(f0 - f1)).alias("ks_stat"),
        F.try_divide(F.sum(F.col("n_0") * value), F.max("tot_0")).alias("mean_a"),
        F.try_divide(F.sum(F.col("n_1") * value), F.max("tot_1")).alias("mean_b"),
    )
    return _every_feature(stats, features, ["n_a", "n_b"])


def _with_ks_p(stats: DataFrame) -> DataFrame:
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    return stats.withColumn(
        "ks_p", kolmogorov_p(F.col("ks_stat"), F.try_divide(na * nb, na + nb))
    ).withColumn("shifted", F.col("ks_p") < DRIFT_ALPHA)


def drift_report(
    train: DataFrame, test: DataFrame, features: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Two-sample distance of each feature between two tables, largest first.

    ``limit`` keeps the first features only; the published report has 20. A feature without values on
    either side has its counts and nothing else.
    """
    features = [c for c in features if c in train.columns and c in test.columns][:limit]
    sides = [
        _long(df, features, [], "double").withColumn("side", F.lit(side))
        for side, df in enumerate((train, test))
    ]
    counts = {"0": fn.flag(F.col("side") == 0), "1": fn.flag(F.col("side") == 1)}
    ladder = score_ladder(sides[0].unionByName(sides[1]), "value", counts, by=["feature"])
    return _with_ks_p(_ks(ladder, features)).orderBy(F.desc_nulls_last("ks_stat"), "feature")


def ks_two_sample(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return drift_report(a, b, [column])


def ks_by_label(df: DataFrame, features: Sequence[str], label: str = "churn_label") -> DataFrame:
    """The same distance between the two label groups of one table."""
    return _with_ks_p(_ks(_two_class_ladder(df, features, label), features))
