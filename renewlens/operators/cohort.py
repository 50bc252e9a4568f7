"""Cohort selection, joins, billing features, labels and cross-source composites."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renewlens import schema as s
from renewlens.functions import buckets
from renewlens.functions import scalars as fn
from renewlens.functions.scalars import flag, quoted
from renewlens.operators.ladder import quantiles
from renewlens.session import stage_counted

KEY = ["Co_Ref", "Renewal_Year"]


# --- filters and projections ------------------------------------------------


def for_year(df: DataFrame, column: str, years: int | Iterable[int] | None) -> DataFrame:
    """Rows of one year or several; None keeps all rows that have a year."""
    if years is None:
        return df.where(F.col(column).isNotNull())
    if isinstance(years, int):
        return df.where(F.col(column) == years)
    return df.where(F.col(column).isin(list(years)))


def post_event_window(df: DataFrame, start: str, end: str, days: int = 28) -> DataFrame:
    """Rows whose end date lies after the start date and at most ``days`` later."""
    limit = F.col(start) + F.expr(f"INTERVAL '{int(days)}' DAY")
    return df.where((F.col(end) > F.col(start)) & (F.col(end) <= limit))


def decided_only(df: DataFrame, outcome: str = "Prospect_Outcome") -> DataFrame:
    return df.where(F.col(outcome).isin(s.DECIDED))


def not_open(df: DataFrame, outcome: str = "Prospect_Outcome") -> DataFrame:
    """Profiling filter: everything but Open, missing outcomes included."""
    return df.where(~F.col(outcome).eqNullSafe(F.lit(s.OPEN)))


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[fn.quoted(c) for c in names if c in df.columns])


def drop_leakage(df: DataFrame) -> DataFrame:
    return df.drop(*s.LEAKAGE)


def drop_before_save(df: DataFrame) -> DataFrame:
    return df.drop(*s.DROP_BEFORE_SAVE)


def model_feature_names(df: DataFrame) -> list[str]:
    """Numeric columns outside the drop list, in table order."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in s.DROP_BEFORE_TRAINING
    ]


def select_model_features(df: DataFrame) -> DataFrame:
    return keep_columns(df, model_feature_names(df))


def with_labels(df: DataFrame, label: str = "churn_label") -> DataFrame:
    return df.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("int"))


def require_non_empty(df: DataFrame, what: str = "cohort") -> DataFrame:
    """Raise when there is no row; looks at one row only."""
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df


def non_empty(base: DataFrame) -> DataFrame:
    """``base`` written once, counted by the job that writes it; an empty one is an error.

    All that is built on it reads the written rows, so its source is scanned once.
    """
    staged, n = stage_counted(base)
    if n == 0:
        raise ValueError("no rows in the post-renewal window")
    return staged


def unique_keys(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``df`` whose plan fails when a key occurs twice.

    The rows of a key meet for the count where the later joins on the key need them anyway.
    """
    per_key = F.count(F.lit(1)).over(Window.partitionBy(*key))
    text = F.concat_ws(" / ", *(F.col(c).cast("string") for c in key))
    twice = F.raise_error(F.concat(F.lit("repeated key: "), text)).cast("boolean")
    return (
        df.withColumn("_rows", per_key)
        .where(F.when(F.col("_rows") > 1, twice).otherwise(F.lit(True)))
        .drop("_rows")
    )


def compound_yes(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Counts of ``value`` among rows where both flags say Yes."""
    return (
        df.where((F.col(a) == "Yes") & (F.col(b) == "Yes") & F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.count("*").alias("n"))
    )


def drop_non_finite(df: DataFrame, column: str) -> DataFrame:
    return df.where(fn.finite(column).isNotNull())


def align_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Absent feature columns appear as 0 and missing values become 0."""
    have = set(df.columns)
    return df.withColumns({
        c: F.coalesce(F.col(fn.quoted(c)), F.lit(0)) if c in have else F.lit(0) for c in names
    })


# --- joins --------------------------------------------------------------------


def left_enrich(base: DataFrame, feats: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Backbone keeps every row; the feature side has one row per key."""
    return base.join(feats, key, "left")


def restrict_to_cohort(calls: DataFrame, base: DataFrame, key: str = "Co_Ref") -> DataFrame:
    """Rows whose key occurs in the cohort, as a semi join; keys are never collected.

    The keys go into the join as they are, so that the planner can also make a Bloom filter of them, of
    bounded size, and drop most other calls before they are shuffled. It does so where the calls are
    large and the cohort comes from a filtered scan; ``session.SESSION_CONF`` sets from which sizes on.
    """
    return calls.join(base.select(key), key, "left_semi")


def attach_label_left(
    df: DataFrame, labels: DataFrame, key: str | Sequence[str] = KEY
) -> DataFrame:
    return df.join(labels, key, "left")


def attach_label_inner(
    df: DataFrame, labels: DataFrame, key: str | Sequence[str] = KEY
) -> DataFrame:
    return df.join(labels, key, "inner")


def fill_numeric_zero(df: DataFrame) -> DataFrame:
    """Missing values of all numeric columns become 0; text and dates stay as they are."""
    return df.fillna(0)


def check_unique_and_count(
    df: DataFrame, key: Sequence[str], expected: DataFrame | None = None
) -> DataFrame:
    """One row: rows, distinct keys, keys that occur twice, expected rows, verdict."""
    per_key = df.groupBy(*key).agg(F.count("*").alias("_n"))
    out = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_keys"),
        F.count_if(F.col("_n") > 1).alias("n_duplicated"),
    )
    n = (
        expected.agg(F.count("*").alias("n")).scalar()
        if expected is not None
        else F.col("n_rows")
    )
    return out.withColumn("n_expected", n).withColumn(
        "ok", (F.col("n_duplicated") == 0) & (F.col("n_rows") == F.col("n_expected"))
    )


def has_record_flags(
    base: DataFrame, sources: dict[str, DataFrame], key: str | Sequence[str] = "Co_Ref"
) -> DataFrame:
    """Adds one 0/1 column per source: 1 when the key has a record there."""
    names = [key] if isinstance(key, str) else list(key)
    for column, source in sources.items():
        keys = source.select(*names).distinct().withColumn("_hit", F.lit(1))
        base = base.join(keys, names, "left").withColumn(
            column, F.coalesce("_hit", F.lit(0))
        ).drop("_hit")
    return base


# --- row-level billing features --------------------------------------------------


def band_encoding(band: str) -> Column:
    pairs = ", ".join(f"'{name}', {order}" for name, order in s.BAND_ORDER.items())
    return F.expr(f"try_element_at(map({pairs}), {band})")


def auto_renewal_off() -> Column:
    """1 unless the flag says yes; a missing flag counts as off."""
    return F.lit(1) - flag(fn.strip_upper("Current_Auto_Renewal_Flag") == "YES")


def billing_flags() -> dict[str, Column]:
    """Row-level features of the cohort table, apart from the score quartile."""
    anchors, tenure = F.col("Current_Anchorings"), F.col("Tenure_Years")
    band, last = F.coalesce(band_encoding("Band"), F.lit(0)), band_encoding("Last_Band")
    return {
        "is_first_year": flag(F.col("Last_Total_Net_Paid").isNull()),
        "auto_renewal_off": auto_renewal_off(),
        "anchoring_zero": flag(anchors == 0),
        "anchoring_1plus": flag(anchors >= 1),
        "anchoring_3plus": flag(anchors >= 3),
        "band_enc": band,
        "band_downgraded": flag(band < last),
        "band_upgraded": flag(band > last),
        "tenure_0_1": flag(tenure <= 1),
        "tenure_2_3": flag((tenure >= 2) & (tenure <= 3)),
        "tenure_4_7": flag((tenure >= 4) & (tenure <= 7)),
        "tenure_8plus": flag(tenure >= 8),
    }


def low_release_score(df: DataFrame, q25: float | None = None) -> DataFrame:
    """1 where the release score is below its cohort's lower quartile.

    The quartile is exact and per renewal year, from a ladder over year and score alone. The cut-offs,
    one per year, reach the rows as a map from a scalar subquery, so the cohort stays one lazy pass.
    ``q25`` fixes the cut-off instead, so that training and scoring can share one.
    """
    score = F.col("Renewal_Score_At_Release")
    if q25 is not None:
        return df.withColumn("low_release_score", flag(score < q25))
    cuts = quantiles(
        df.select("Renewal_Year", "Renewal_Score_At_Release"), "Renewal_Score_At_Release",
        {"_q25": 0.25}, by=["Renewal_Year"],
    )
    by_year = cuts.agg(
        F.map_from_entries(F.collect_list(F.struct("Renewal_Year", "_q25"))).alias("cuts")
    ).scalar()
    cut = F.try_element_at(by_year, F.col("Renewal_Year"))
    return df.withColumn("low_release_score", flag(score < cut))


def with_profiling_features(df: DataFrame) -> DataFrame:
    """Billing columns used only for profiling: several of them reveal the outcome."""
    change = F.coalesce(
        fn.ratio_change("Total_Net_Paid", "Last_Total_Net_Paid"), F.lit(0.0)
    )
    return df.withColumns({
        "is_first_year": flag(F.col("Last_Total_Net_Paid").isNull()),
        "payment_unknown": flag(F.upper("Payment_Method") == "UNKNOWN"),
        "auto_renewal_off": auto_renewal_off(),
        "anchoring_zero": flag(F.col("Current_Anchorings") == 0),
        "price_change_pct": change,
        "price_increase_flag": flag(change > 0),
        "price_increase_10pct": flag(change > 0.10),
        "renewal_score_delta": F.coalesce(
            F.col("Total_Renewal_Score_New") - F.col("Renewal_Score_At_Release"), F.lit(0.0)
        ),
        "has_world_pay_token": flag(F.col("Current_World_Pay_Token").isNotNull()),
        "payment_timeframe_flag": flag(F.col("Payment_Timeframe").isNotNull()),
        "tenure_bucket": buckets.bucketize_right("Tenure_Years", *buckets.TENURE),
        "price_bucket": buckets.bucketize_right(change, *buckets.PRICE_4),
        "price_bucket5": buckets.bucketize_right(change, *buckets.PRICE_5),
    })


def band_enc_sorted(df: DataFrame) -> DataFrame:
    """Ordinal of the band in the sorted list of bands that occur; unknown or missing gives -1.

    The list is the ranked distinct bands, joined back for both columns; the planner picks the joins.
    """
    ranked = (
        df.where(F.col("Band").isNotNull()).select("Band").distinct()
        .select("Band", (F.dense_rank().over(Window.orderBy("Band")) - 1).alias("_rank"))
    )
    now = ranked.select("Band", F.col("_rank").alias("_now"))
    last = ranked.select(F.col("Band").alias("Last_Band"), F.col("_rank").alias("_last"))
    return (
        df.join(now, "Band", "left").join(last, "Last_Band", "left")
        .withColumn("band_enc", F.coalesce("_now", F.lit(-1)))
        .withColumn("band_downgraded", flag(F.col("band_enc") < F.col("_last")))
        .select(*(quoted(c) for c in df.columns if c not in ("band_enc", "band_downgraded")), "band_enc", "band_downgraded")
    )


# --- cohort, labels, composites ---------------------------------------------------


def cohort_rows(
    bills: DataFrame, years: int | Iterable[int] | None = None, days: int = 28
) -> DataFrame:
    """Decided renewals that closed within the window after their renewal date."""
    rows = for_year(bills, "Renewal_Year", years)
    return decided_only(
        post_event_window(rows, "Prospect_Renewal_Date", "Closed_Date", days)
    )


def build_labels(
    bills: DataFrame, years: int | Iterable[int] | None = None, days: int = 28
) -> DataFrame:
    return cohort_rows(bills, years, days).select(
        "Co_Ref",
        "Renewal_Year",
        flag(F.col("Prospect_Outcome") == s.CHURNED).alias("churn_label"),
        F.col("Prospect_Outcome").alias("outcome_post_renewal"),
    )


def build_billing_features(
    bills: DataFrame,
    years: int | Iterable[int] | None = None,
    days: int = 28,
    q25: float | None = None,
    check: bool = True,
) -> DataFrame:
    """Kept billing columns and the 13 derived features, one row per customer and year.

    An empty cohort is an error here and a repeated key fails the run, unless ``check`` is off. The
    check stages the cohort rows, which the quartiles and the result then read.
    """
    base = keep_columns(cohort_rows(bills, years, days), s.BILLING_KEEP)
    if check:
        base = non_empty(base)
    done = low_release_score(base, q25).withColumns(billing_flags())
    return unique_keys(done) if check else done


def composites(
    negative_flags: Sequence[str] = s.NEGATIVE_FLAGS, multiple: str = "cc_multiple_calls"
) -> dict[str, Column]:
    """Cross-source features; they expect zero-filled inputs.

    ``multiple='cc_call_count'`` is the profiling variant that counts calls directly.
    """
    contacts = F.col("cc_call_count") + F.col("rc_call_count")
    many = (
        F.col("cc_multiple_calls") == 1
        if multiple == "cc_multiple_calls"
        else F.col("cc_call_count") >= 3
    )
    negatives = F.col(negative_flags[0])
    for name in negative_flags[1:]:
        negatives = negatives + F.col(name)
    return {
        "any_leave_signal": flag(
            (F.col("cc_ever_suggest_leave") == 1) | (F.col("rc_switching_intent") == 1)
        ),
        "any_competitor_signal": flag(F.col("rc_competitor_mentioned") == 1),
        "any_financial_hardship": flag(F.col("cc_ever_hardship") == 1),
        "any_complaint": flag(F.col("cc_ever_complained") == 1),
        "total_negative_flags": negatives,
        "total_contact_count": contacts,
        "has_no_behavioural_data": flag(contacts == 0),
        "high_friction_score": flag(F.col("rc_max_call_number") >= 3)
        + flag(F.col("rc_discount_requested") == 1)
        + flag(F.col("rc_rescheduled") == 1)
        + flag(many),
        "critical_risk_billing": flag(
            (F.col("auto_renewal_off") == 1) & (F.col("anchoring_zero") == 1)
        ),
    }


def add_composite_features(
    df: DataFrame,
    negative_flags: Sequence[str] = s.NEGATIVE_FLAGS,
    multiple: str = "cc_multiple_calls",
) -> DataFrame:
    return df.withColumns(composites(negative_flags, multiple))


def imbalance_ratio(df: DataFrame, label: str = "churn_label") -> DataFrame:
    """Negatives per positive, the usual positive-class weight."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(
        neg.alias("n_negative"), pos.alias("n_positive"), F.try_divide(neg, pos).alias("ratio")
    )
