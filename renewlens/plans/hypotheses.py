"""The hypothesis table: all tests of one kind share one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens import schema as s
from renewlens.operators import cohort as c
from renewlens.operators.behaviour import build_email_features
from renewlens.operators.profiling import feature_lift
from renewlens.operators.stattests import chi_square_tests, mann_whitney_tests
from renewlens.plans.features import build_cohort_features
from renewlens.session import stage


def hypothesis_features(
    bills: DataFrame, cc: DataFrame, rc: DataFrame, emails: DataFrame, years: int | Sequence[int] | None = None
) -> DataFrame:
    """The feature table with what the hypotheses need besides: price, payment and e-mail columns.

    These tell about the outcome or come after it, so they stay out of the model table. E-mail features
    are one row per customer; a customer without e-mails has a share of 0.
    """
    table = build_cohort_features(bills, cc, rc, years)
    billing = c.with_profiling_features(c.cohort_rows(bills, years)).select(*c.KEY, *s.PROFILING_TESTED)
    mails = build_email_features(emails).select("Co_Ref", *s.EMAIL_TESTED)
    joined = c.left_enrich(c.left_enrich(table, billing, c.KEY), mails, "Co_Ref")
    return joined.fillna(0, subset=[*s.PROFILING_TESTED, *s.EMAIL_TESTED])


def hypothesis_summary(
    df: DataFrame,
    specs: Sequence[tuple[str, str, str]] = tuple(s.HYPOTHESES),
    label: str = "churn_label",
) -> DataFrame:
    """One row per hypothesis; features the table lacks are skipped.

    Chi-square rows carry churn at 0 and 1 and the lift, rank-test rows the two means. The columns
    under test are staged once; three kinds of jobs read them.
    """
    specs = [(i, h, f, kind) for i, (h, f, kind) in enumerate(specs) if f in df.columns]
    spark = df.sparkSession
    listed = spark.createDataFrame(
        specs, "position int, hypothesis string, feature string, test string"
    )
    columns = "feature string, p_value double, effect_size double, churn_if_0 double, " \
        "churn_if_1 double, lift double, mean_retained double, mean_churned double, " \
        "significant boolean"
    binary = [f for _, _, f, kind in specs if kind == "Chi-square"]
    ranked = [f for _, _, f, kind in specs if kind == "Mann-Whitney"]
    df = stage(df.select(label, *dict.fromkeys(binary + ranked)))
    results = spark.createDataFrame([], columns)
    none = F.lit(None).cast("double")
    if binary:
        rates = feature_lift(df, binary, label).withColumnRenamed("column", "feature")
        results = results.unionByName(
            chi_square_tests(df, binary, label).join(rates, "feature").select(
                "feature",
                F.round("p_value", 6).alias("p_value"),
                F.round("cramers_v", 4).alias("effect_size"),
                F.round("pct_0", 1).alias("churn_if_0"),
                F.round("pct_1", 1).alias("churn_if_1"),
                F.round("lift", 2).alias("lift"),
                none.alias("mean_retained"),
                none.alias("mean_churned"),
                "significant",
            )
        )
    if ranked:
        results = results.unionByName(
            mann_whitney_tests(df, ranked, label).select(
                "feature",
                F.round("p_value", 6).alias("p_value"),
                F.round("effect_size_r", 4).alias("effect_size"),
                none.alias("churn_if_0"),
                none.alias("churn_if_1"),
                none.alias("lift"),
                F.round("mean_0", 3).alias("mean_retained"),
                F.round("mean_1", 3).alias("mean_churned"),
                "significant",
            )
        )
    return listed.join(results, "feature").orderBy("position").drop("position")
