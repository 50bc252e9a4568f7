"""The feature table of one cohort year or of all years at once."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from renewlens import schema as s
from renewlens.functions import buckets
from renewlens.functions.scalars import flag
from renewlens.operators import behaviour as b
from renewlens.operators import cohort as c
from renewlens.session import stage


def build_cohort_features(
    bills: DataFrame,
    cc: DataFrame,
    rc: DataFrame,
    years: int | Iterable[int] | None = None,
    include_labels: bool = True,
    days: int = 28,
    q25: float | None = None,
    check: bool = True,
) -> DataFrame:
    """Billing, support-call and renewal-call features of every cohort row, plus composites.

    Keyed by customer and renewal year, so one plan serves any number of years. Calls are reduced
    to one row per key before the joins; every exchange is on that key. So a join can change neither the
    number of rows nor their keys; an empty cohort or a repeated key fails the run.
    """
    base = c.build_billing_features(bills, years, days, q25, check)
    df = c.left_enrich(base, b.build_cc_features(cc, years), c.KEY)
    df = c.left_enrich(df, b.build_rc_features(rc, years), c.KEY)
    df = c.add_composite_features(c.fill_numeric_zero(df))
    if include_labels:
        # the label is a function of the cohort row itself, so no second pass over billings
        df = df.withColumns({
            "churn_label": flag(F.col("Prospect_Outcome") == s.CHURNED),
            "outcome_post_renewal": F.col("Prospect_Outcome"),
        })
    return df


def train_test_predict(
    bills: DataFrame, cc: DataFrame, rc: DataFrame, train_year: int = 2024, test_year: int = 2025
) -> dict[str, DataFrame]:
    """The three tables of the workflow: labelled train, labelled test, unlabelled scoring.

    Cut-offs are per year, so both years come from one build that is written once.
    """
    both = stage(build_cohort_features(bills, cc, rc, [train_year, test_year]))
    test = both.where(F.col("Renewal_Year") == test_year)
    return {
        "train": both.where(F.col("Renewal_Year") == train_year),
        "test": test,
        "predict": test.drop("churn_label", "outcome_post_renewal"),
    }


def build_profiling_features(
    bills: DataFrame, cc: DataFrame, rc: DataFrame, years: int | Sequence[int] | None = None
) -> DataFrame:
    """Wider table for exploration, with the outcome-revealing billing columns still in it."""
    base = c.band_enc_sorted(c.with_profiling_features(c.cohort_rows(bills, years)))
    df = c.left_enrich(base, b.build_cc_features(cc, years), c.KEY)
    df = c.left_enrich(df, b.build_rc_features(rc, years), c.KEY)
    df = c.add_composite_features(
        c.fill_numeric_zero(df), s.NEGATIVE_FLAGS_PROFILING, "cc_call_count"
    )
    return df.withColumns({
        "flag_bucket": buckets.bucketize_right("total_negative_flags", *buckets.FLAG_COUNT),
        "churn_label": flag(F.col("Prospect_Outcome") == s.CHURNED),
        "outcome_post_renewal": F.col("Prospect_Outcome"),
    })
