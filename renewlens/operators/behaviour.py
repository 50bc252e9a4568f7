"""Per-customer aggregates of calls and e-mails.

Each builder is one hash aggregation keyed by customer and year. Partial aggregation runs before the
shuffle, so a customer with a third of all calls still sends one row per map task. The result is
partitioned by the join key of the cohort table, which lets the enriching joins reuse it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens import schema as s
from renewlens.functions.scalars import flag
from renewlens.operators.cohort import drop_leakage, for_year


def _ever(column: str) -> Column:
    return F.max(flag(F.col(column) == "Yes"))


def sentiment_delta() -> Column:
    """End score minus start score, null when either is missing."""
    return F.col("cc_contractor_sentiment_end_score") - F.col(
        "cc_contractor_sentiment_start_score"
    )


def _keyed(calls: DataFrame, year_column: str, years: int | Iterable[int] | None) -> DataFrame:
    """Rows that can belong to a cohort row: a customer key and a year."""
    return (
        for_year(calls, year_column, years)
        .where(F.col("Co_Ref").isNotNull())
        .withColumn("Renewal_Year", F.col(year_column))
    )


def build_cc_features(
    calls: DataFrame, years: int | Iterable[int] | None = None
) -> DataFrame:
    """15 support-call features per customer and year."""
    feats = (
        _keyed(calls, "Call_Year", years)
        .groupBy("Co_Ref", "Renewal_Year")
        .agg(
            F.count("Call_Year").alias("cc_call_count"),
            *[_ever(column).alias(name) for name, column in s.CC_EVER.items()],
            F.avg(
                flag(F.col("cc_contractor_sentiment_clean") == "Dissatisfied").cast("double")
            ).alias("cc_pct_dissatisfied"),
            F.avg(sentiment_delta()).alias("cc_avg_sentiment_delta"),
            F.min("cc_contractor_sentiment_overall_score").alias("cc_min_overall_sentiment"),
            F.count_if(F.col("Direction") == "IN_BOUND").alias("cc_inbound_count"),
        )
    )
    return feats.withColumns({
        "cc_inbound_ratio": F.coalesce(
            F.try_divide(F.col("cc_inbound_count"), F.col("cc_call_count")), F.lit(0.0)
        ),
        "cc_sentiment_worsened": flag(F.col("cc_avg_sentiment_delta") < 0),
        "cc_multiple_calls": flag(F.col("cc_call_count") >= 3),
    })


def build_rc_features(
    calls: DataFrame, years: int | Iterable[int] | None = None
) -> DataFrame:
    """14 renewal-call features per customer and year, from leakage-free columns only."""
    feats = (
        _keyed(drop_leakage(calls), "Call_Year", years)
        .groupBy("Co_Ref", "Renewal_Year")
        .agg(
            F.count("Call_Year").alias("rc_call_count"),
            F.max("Call_Number").alias("rc_max_call_number"),
            *[_ever(column).alias(name) for name, column in s.RC_EVER.items()],
            F.count_if(F.col("Call_Direction") == "Outbound").alias("rc_outbound_count"),
        )
    )
    return feats.withColumns({
        "rc_high_friction": flag(F.col("rc_max_call_number") >= 3),
        "rc_agent_chased": flag(F.col("rc_outbound_count") >= 2),
    })


def build_email_features(emails: DataFrame, window: str = "prior_year") -> DataFrame:
    """14 e-mail features per customer, for profiling only.

    E-mails of this source arrive after the renewal decision, so they never enter the model table;
    they are joined by customer key alone.
    """
    return (
        emails.where((F.col("Time_to_Renewal") == window) & F.col("Co_Ref").isNotNull())
        .groupBy("Co_Ref")
        .agg(
            *[_ever(column).alias(name) for name, column in s.EMAIL_EVER.items()],
            F.avg(
                flag(F.col("crm_contractor_sentiment_clean") == "Negative").cast("double")
            ).alias("email_pct_negative"),
            F.avg("crm_contractor_sentiment_score").alias("email_avg_sentiment_score"),
            F.min("crm_contractor_sentiment_score").alias("email_min_sentiment_score"),
            F.count("*").alias("email_count"),
            F.sum("crm_agent_chase_count").alias("email_chase_count_total"),
            F.avg(flag(F.col("crm_contractor_engagement") == "No").cast("double")).alias(
                "email_pct_not_engaged"
            ),
        )
    )
