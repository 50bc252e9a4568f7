"""Cohort, joins, billing flags, behavioural aggregates, composites and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.checks.oracles import flag as sflag
from renewlens.checks.registry import Tables, query
from renewlens.functions import buckets, scalars as fn
from renewlens.operators import behaviour as b
from renewlens.operators import cohort as c
from renewlens.operators import keysets as ks
from renewlens.plans.features import build_profiling_features
from renewlens.session import shared_dir
from renewlens.sources import tables as src

BILLING_FLAGS = [
    "is_first_year", "auto_renewal_off", "anchoring_zero", "anchoring_1plus", "anchoring_3plus",
    "band_enc", "band_downgraded", "band_upgraded", "low_release_score", "tenure_0_1",
    "tenure_2_3", "tenure_4_7", "tenure_8plus",
]
COMPOSITES = [
    "any_leave_signal", "any_competitor_signal", "any_financial_hardship", "any_complaint",
    "total_negative_flags", "total_contact_count", "has_no_behavioural_data",
    "high_friction_score", "critical_risk_billing",
]


def _ints(df: DataFrame, names: list[str], kind: str = "bigint") -> list:
    return [F.col(n).cast(kind).alias(n) for n in names]


# --- filters ---------------------------------------------------------------------


@query("F01", "select Co_Ref, Prospect_Outcome from bills where Renewal_Year = 1997", ["bills"])
def for_year(t: Tables) -> DataFrame:
    return c.for_year(t.bills, "Renewal_Year", 1997).select("Co_Ref", "Prospect_Outcome")


@query(
    "F02",
    """select Co_Ref, Renewal_Year from bills where Closed_Date > Prospect_Renewal_Date
       and Closed_Date <= Prospect_Renewal_Date + interval 28 day""",
    ["bills"],
)
def post_event_window(t: Tables) -> DataFrame:
    return c.post_event_window(t.bills, "Prospect_Renewal_Date", "Closed_Date").select(
        "Co_Ref", "Renewal_Year"
    )


@query(
    "F03 F04",
    """select Prospect_Outcome, count(*) as n,
         sum(case when Prospect_Outcome in ('Won', 'Churned') then 1 else 0 end)::bigint as decided
       from bills where Prospect_Outcome is distinct from 'Open' group by 1""",
    ["bills"],
)
def decided_and_not_open(t: Tables) -> DataFrame:
    decided = c.decided_only(t.bills).groupBy("Prospect_Outcome").agg(
        F.count("*").alias("decided")
    )
    rest = c.not_open(t.bills).groupBy("Prospect_Outcome").agg(F.count("*").alias("n"))
    return rest.join(decided, "Prospect_Outcome", "left").select(
        "Prospect_Outcome", "n", F.coalesce("decided", F.lit(0)).alias("decided")
    )


@query(
    "F09 F10 X07",
    """select Co_Ref, Renewal_Year, case when Prospect_Outcome = 'Churned' then 1 else 0 end
         as churn_label, Prospect_Outcome as outcome_post_renewal from cohort0""",
    ["cohort0"],
)
def build_labels(t: Tables) -> DataFrame:
    return c.with_labels(c.require_non_empty(c.build_labels(t.bills)))


@query(
    "F11",
    """select Call_Direction, count(*) as n from rc where Explicit_Switching_Intent = 'Yes'
       and Explicit_Competitor_Mention = 'Yes' and Call_Direction is not null group by 1""",
    ["rc"],
)
def compound_yes(t: Tables) -> DataFrame:
    return c.compound_yes(
        t.rc, "Explicit_Switching_Intent", "Explicit_Competitor_Mention", "Call_Direction"
    )


@query(
    "F12 D09",
    """select Co_Ref, Renewal_Year,
         (Total_Net_Paid - Last_Total_Net_Paid) / Last_Total_Net_Paid as change from bills
       where Last_Total_Net_Paid is not null and Last_Total_Net_Paid <> 0
         and Total_Net_Paid is not null""",
    ["bills"],
    ["change"],
)
def drop_non_finite(t: Tables) -> DataFrame:
    ratio = t.bills.withColumn(
        "change", fn.ratio_change("Total_Net_Paid", "Last_Total_Net_Paid")
    )
    return c.drop_non_finite(ratio, "change").select("Co_Ref", "Renewal_Year", "change")


@query(
    "F13",
    """select Co_Ref, Renewal_Year, least(greatest(Current_Anchorings, 1), 5) as clipped,
         case when Renewal_Score_At_Release is not null
           then least(Renewal_Score_At_Release, 5000) end as capped from bills""",
    ["bills"],
    ["clipped", "capped"],
)
def clip(t: Tables) -> DataFrame:
    return t.bills.select(
        "Co_Ref", "Renewal_Year",
        fn.clip("Current_Anchorings", 1.0, 5.0).alias("clipped"),
        fn.clip("Renewal_Score_At_Release", upper=5000.0).alias("capped"),
    )


@query(
    "F14",
    """select Co_Ref, Renewal_Year, coalesce(Last_Total_Net_Paid, 0) as Last_Total_Net_Paid,
         0 as never_seen from bills""",
    ["bills"],
    ["Last_Total_Net_Paid"],
)
def align_columns(t: Tables) -> DataFrame:
    return c.align_columns(
        t.bills.select("Co_Ref", "Renewal_Year", "Last_Total_Net_Paid"),
        ["Last_Total_Net_Paid", "never_seen"],
    )


# --- joins ------------------------------------------------------------------------


@query(
    "J01",
    """select c.Co_Ref, c.Renewal_Year, rc_call_count from cohort0 c left join rcf
         on rcf.Co_Ref = c.Co_Ref and rcf.Renewal_Year = c.Renewal_Year""",
    ["cohort0", "rcf"],
    ["rc_call_count"],
)
def left_enrich(t: Tables) -> DataFrame:
    base = c.cohort_rows(t.bills).select(*c.KEY)
    return c.left_enrich(base, b.build_rc_features(t.rc), c.KEY).select(
        *c.KEY, F.col("rc_call_count").cast("double").alias("rc_call_count")
    )


@query(
    "J01 S07 S08",
    """select c.Co_Ref, c.Renewal_Year, cc_call_count, rc_call_count, cc_ever_complained from cohort0 c
       left join ccf on ccf.Co_Ref = c.Co_Ref and ccf.Renewal_Year = c.Renewal_Year
       left join rcf on rcf.Co_Ref = c.Co_Ref and rcf.Renewal_Year = c.Renewal_Year""",
    ["cohort0", "ccf", "rcf"],
    ["cc_call_count", "rc_call_count", "cc_ever_complained"],
)
def enrich_stored_tables(t: Tables) -> DataFrame:
    """Cohort and both call tables, stored by key; the joins of the stored tables need no shuffle."""
    run = uuid.uuid4().hex
    parts = {
        "cohort": c.cohort_rows(t.bills).select(*c.KEY),
        "cc": b.build_cc_features(t.cc).select(*c.KEY, "cc_call_count", "cc_ever_complained"),
        "rc": b.build_rc_features(t.rc).select(*c.KEY, "rc_call_count"),
    }
    stored = {
        n: src.write_keyed(df, f"{n}_{run}", f"{shared_dir(t.spark)}/keyed-{run}/{n}", 8) for n, df in parts.items()
    }
    joined = c.left_enrich(c.left_enrich(stored["cohort"], stored["cc"], c.KEY), stored["rc"], c.KEY)
    return joined.withColumns({n: F.col(n).cast("double") for n in joined.columns[2:]})


@query(
    "J02",
    """select Call_Year, count(*) as n from rc
       where Co_Ref in (select Co_Ref from cohort0) group by 1""",
    ["rc", "cohort0"],
)
def restrict_to_cohort(t: Tables) -> DataFrame:
    calls = c.restrict_to_cohort(t.rc, c.cohort_rows(t.bills))
    return calls.groupBy("Call_Year").agg(F.count("*").alias("n"))


@query(
    "J03 J04",
    """select 'left' as kind, count(*) as n, count(l.label)::bigint as labelled from bills b
         left join (select Co_Ref, Renewal_Year, 1 as label from cohort0) l
         on l.Co_Ref = b.Co_Ref and l.Renewal_Year = b.Renewal_Year
       union all select 'inner', count(*), count(*) from cohort0""",
    ["bills", "cohort0"],
)
def attach_labels(t: Tables) -> DataFrame:
    labels = c.build_labels(t.bills)
    base = t.bills.select(*c.KEY)
    parts = [
        joined.agg(F.count("*").alias("n"), F.count("churn_label").alias("labelled")).select(
            F.lit(kind).alias("kind"), "n", "labelled"
        )
        for kind, joined in (
            ("left", c.attach_label_left(base, labels)),
            ("inner", c.attach_label_inner(base, labels)),
        )
    ]
    return parts[0].unionByName(parts[1])


@query(
    "J05",
    """select Co_Ref, Renewal_Year, Band, coalesce(Last_Total_Net_Paid, 0) as Last_Total_Net_Paid,
         coalesce(Renewal_Score_At_Release, 0) as Renewal_Score_At_Release from bills""",
    ["bills"],
    ["Last_Total_Net_Paid", "Renewal_Score_At_Release"],
)
def fill_numeric_zero(t: Tables) -> DataFrame:
    return c.fill_numeric_zero(t.bills.select(
        "Co_Ref", "Renewal_Year", "Band", "Last_Total_Net_Paid", "Renewal_Score_At_Release"
    ))


@query(
    "J06",
    """select count(*) as n_rows, count(*) as n_keys, 0::bigint as n_duplicated,
         (select count(*) from cohort0) as n_expected, true as ok from joined""",
    ["joined"],
)
def check_unique_and_count(t: Tables) -> DataFrame:
    return c.check_unique_and_count(t.features, c.KEY, c.cohort_rows(t.bills))


@query(
    "J07",
    """select Co_Ref, Renewal_Year,
         case when Co_Ref in (select Co_Ref from cc where Co_Ref is not null) then 1 else 0 end
           as has_cc,
         case when Co_Ref in (select Co_Ref from rc where Co_Ref is not null) then 1 else 0 end
           as has_rc from cohort0""",
    ["cohort0", "cc", "rc"],
)
def has_record_flags(t: Tables) -> DataFrame:
    base = c.cohort_rows(t.bills).select(*c.KEY)
    return c.has_record_flags(base, {"has_cc": t.cc, "has_rc": t.rc}).select(
        *c.KEY, "has_cc", "has_rc"
    )


# --- billing features ----------------------------------------------------------------


@query(
    "X08 D01 D02 D03 D04 D05 D06 D07",
    f"select Co_Ref, Renewal_Year, {', '.join(BILLING_FLAGS)} from cohort",
    ["cohort"],
)
def build_billing_features(t: Tables) -> DataFrame:
    return c.build_billing_features(t.bills).select("Co_Ref", "Renewal_Year", *BILLING_FLAGS)


@query(
    "D06",
    """select Co_Ref, Renewal_Year, case when Renewal_Score_At_Release < 2000 then 1 else 0 end
         as low_release_score from cohort0""",
    ["cohort0"],
)
def low_release_score_fixed(t: Tables) -> DataFrame:
    return c.low_release_score(c.cohort_rows(t.bills), q25=2000.0).select(
        *c.KEY, "low_release_score"
    )


@query(
    "D08 D09 D10 D13 D14 D15 D16",
    f"""select Co_Ref, Renewal_Year, {sflag("Payment_Method = 'UNKNOWN'")} as payment_unknown,
          ch as price_change_pct, {sflag('ch > 0')} as price_increase_flag,
          {sflag('ch > 0.1')} as price_increase_10pct, 0 as has_world_pay_token,
          case when Tenure_Years <= -1 then null when Tenure_Years <= 1 then '0-1yr'
            when Tenure_Years <= 3 then '2-3yr' when Tenure_Years <= 7 then '4-7yr'
            when Tenure_Years <= 100 then '8+yr' end as tenure_bucket,
          case when ch <= -0.01 then 'Decreased' when ch <= 0.01 then 'Flat'
            when ch <= 0.1 then '1-10% up' else '>10% up' end as price_bucket,
          case when ch <= -0.01 then 'Decreased' when ch <= 0.01 then 'Flat'
            when ch <= 0.1 then '1-10% up' when ch <= 0.2 then '10-20% up' else '>20% up' end
            as price_bucket5
        from (select *, coalesce(case when Last_Total_Net_Paid <> 0
            then (Total_Net_Paid - Last_Total_Net_Paid) / Last_Total_Net_Paid end, 0) as ch
          from bills)""",
    ["bills"],
    ["price_change_pct"],
)
def profiling_billing_features(t: Tables) -> DataFrame:
    return c.with_profiling_features(t.bills).select(
        "Co_Ref", "Renewal_Year", "payment_unknown", "price_change_pct", "price_increase_flag",
        "price_increase_10pct", "has_world_pay_token", "tenure_bucket", "price_bucket",
        "price_bucket5",
    )


@query(
    "D11 W05",
    """select Co_Ref, Renewal_Year, band_enc,
         case when band_enc < last_enc then 1 else 0 end as band_downgraded from (
           select b.*, coalesce(m.ord, -1)::integer as band_enc, l.ord as last_enc from bills b
             left join (select Band as name, dense_rank() over (order by Band) - 1 as ord
               from (select distinct Band from bills where Band is not null)) m on m.name = b.Band
             left join (select Band as name, dense_rank() over (order by Band) - 1 as ord
               from (select distinct Band from bills where Band is not null)) l
               on l.name = b.Last_Band)""",
    ["bills"],
)
def band_enc_sorted(t: Tables) -> DataFrame:
    return c.band_enc_sorted(t.bills).select("Co_Ref", "Renewal_Year", "band_enc", "band_downgraded")


@query(
    "D12 D18",
    """select Co_Ref, Renewal_Year, coalesce(delta, 0) as renewal_score_delta,
         case when delta <= -0.01 then 'Decreased' when delta <= 0.01 then 'Flat'
           when delta is not null then 'Increased' end as score_direction
       from (select *, Connection_Qty * 100 - Renewal_Score_At_Release as delta from bills)""",
    ["bills"],
    ["renewal_score_delta"],
)
def score_delta(t: Tables) -> DataFrame:
    df = c.with_profiling_features(
        t.bills.withColumn("Total_Renewal_Score_New", F.col("Connection_Qty") * 100)
    )
    delta = F.col("Total_Renewal_Score_New") - F.col("Renewal_Score_At_Release")
    return df.select(
        "Co_Ref", "Renewal_Year", "renewal_score_delta",
        buckets.bucketize_right(delta, *buckets.SCORE_DIRECTION).alias("score_direction"),
    )


@query(
    "D17",
    """select Co_Ref, Renewal_Year, case when ch <= -0.01 then 'Decreased' when ch <= 0.01 then 'Flat'
         when ch <= 10 then '1-10% Increase' when ch is not null then '10%+ Increase' end as bucket
       from (select *, case when Last_Total_Net_Paid <> 0
           then (Total_Net_Paid - Last_Total_Net_Paid) / Last_Total_Net_Paid * 100 end as ch
         from bills)""",
    ["bills"],
)
def price_change_bucket(t: Tables) -> DataFrame:
    change = fn.ratio_change("Total_Net_Paid", "Last_Total_Net_Paid") * 100
    return t.bills.select(
        "Co_Ref", "Renewal_Year",
        buckets.bucketize_right(change, *buckets.PRICE_PERCENT).alias("bucket"),
    )


@query(
    "D21",
    """select case when sentiment_delta < 0 then 'Worse' when sentiment_delta > 0 then 'Improved'
         when sentiment_delta = 0 then 'Same' end as change, count(*) as n from cc group by 1""",
    ["cc"],
)
def sentiment_change(t: Tables) -> DataFrame:
    return t.cc.select(buckets.sentiment_change(b.sentiment_delta()).alias("change")).groupBy(
        "change"
    ).agg(F.count("*").alias("n"))


# --- behavioural aggregates ----------------------------------------------------------


@query(
    "A01 A02 A04 A05 A06 A07 A09 A10 A11",
    """select Co_Ref, Renewal_Year, cc_call_count, cc_ever_suggest_leave, 0 as cc_ever_hardship,
         cc_ever_complained, cc_ever_platform_issues, cc_pct_dissatisfied, cc_avg_sentiment_delta,
         cc_inbound_count, cc_inbound_count::double / cc_call_count as cc_inbound_ratio,
         case when cc_avg_sentiment_delta < 0 then 1 else 0 end as cc_sentiment_worsened,
         case when cc_call_count >= 3 then 1 else 0 end as cc_multiple_calls from ccf""",
    ["ccf"],
    ["cc_pct_dissatisfied", "cc_avg_sentiment_delta", "cc_inbound_ratio"],
)
def build_cc_features(t: Tables) -> DataFrame:
    return b.build_cc_features(t.cc).select(
        "Co_Ref", "Renewal_Year", "cc_call_count", "cc_ever_suggest_leave", "cc_ever_hardship",
        "cc_ever_complained", "cc_ever_platform_issues", "cc_pct_dissatisfied",
        "cc_avg_sentiment_delta", "cc_inbound_count", "cc_inbound_ratio",
        "cc_sentiment_worsened", "cc_multiple_calls",
    )


@query(
    "A01 A03 A07 A08 A11",
    """select Co_Ref, Renewal_Year, rc_call_count, rc_max_call_number, rc_discount_requested,
         0 as rc_price_discussed, rc_competitor_mentioned, rc_switching_intent, rc_rescheduled,
         rc_outbound_count, case when rc_max_call_number >= 3 then 1 else 0 end as rc_high_friction,
         case when rc_outbound_count >= 2 then 1 else 0 end as rc_agent_chased from rcf""",
    ["rcf"],
    ["rc_max_call_number"],
)
def build_rc_features(t: Tables) -> DataFrame:
    return b.build_rc_features(t.rc).select(
        "Co_Ref", "Renewal_Year", "rc_call_count", "rc_max_call_number", "rc_discount_requested",
        "rc_price_discussed", "rc_competitor_mentioned", "rc_switching_intent", "rc_rescheduled",
        "rc_outbound_count", "rc_high_friction", "rc_agent_chased",
    )


@query(
    "A06",
    """select nullif(trim(cast(Co_Ref as varchar)), '') as Co_Ref, Call_Year as Renewal_Year,
         min(try_cast(cc_contractor_sentiment_end_score as double)) as cc_min_overall_sentiment
       from cc_calls group by all""",
    ["cc_calls"],
    ["cc_min_overall_sentiment"],
)
def min_overall_sentiment(t: Tables) -> DataFrame:
    """The stand-in has no overall score, so the end score takes its place here."""
    calls = t.cc.withColumn(
        "cc_contractor_sentiment_overall_score", F.col("cc_contractor_sentiment_end_score")
    )
    return b.build_cc_features(calls).select("Co_Ref", "Renewal_Year", "cc_min_overall_sentiment")


@query(
    "A12",
    """select Co_Ref, max(case when crm_customer_complained = 'Yes' then 1 else 0 end)
           as email_ever_complained,
         avg(case when crm_contractor_sentiment_clean = 'Negative' then 1 else 0 end)
           as email_pct_negative,
         count(*) as email_count, sum(crm_agent_chase_count) as email_chase_count_total
       from em where Time_to_Renewal = 'prior_year' and Co_Ref is not null group by 1""",
    ["em"],
    ["email_pct_negative", "email_chase_count_total"],
)
def build_email_features(t: Tables) -> DataFrame:
    return b.build_email_features(t.emails).select(
        "Co_Ref", "email_ever_complained", "email_pct_negative", "email_count",
        "email_chase_count_total",
    )


# --- the feature table ---------------------------------------------------------------


@query(
    "X01 X02 X03 X04 X05 X06 X09",
    f"""select Co_Ref, Renewal_Year, churn_label, Prospect_Outcome as outcome_post_renewal,
          cc_call_count, rc_call_count, cc_inbound_ratio, cc_pct_dissatisfied,
          {', '.join(f'{n}::bigint as {n}' for n in COMPOSITES)} from features""",
    ["features"],
    ["cc_inbound_ratio", "cc_pct_dissatisfied"],
)
def build_cohort_features(t: Tables) -> DataFrame:
    return t.features.select(
        "Co_Ref", "Renewal_Year", "churn_label", "outcome_post_renewal", "cc_call_count",
        "rc_call_count", "cc_inbound_ratio", "cc_pct_dissatisfied",
        *_ints(t.features, COMPOSITES),
    )


@query(
    "X10",
    """select Renewal_Year, count(*) as n, sum(churn_label)::bigint as churned from cohort
       where Renewal_Year in (1996, 1997) group by 1""",
    ["cohort"],
)
def train_and_test_tables(t: Tables) -> DataFrame:
    from renewlens.plans.features import train_test_predict

    parts = train_test_predict(t.bills, t.cc, t.rc, 1996, 1997)
    both = parts["train"].unionByName(parts["test"])
    return both.groupBy("Renewal_Year").agg(
        F.count("*").alias("n"), F.sum("churn_label").alias("churned")
    )


@query(
    "X11",
    """select sum(1 - churn_label)::bigint as n_negative, sum(churn_label)::bigint as n_positive,
         sum(1 - churn_label)::double / sum(churn_label) as ratio from cohort""",
    ["cohort"],
    ["ratio"],
)
def imbalance_ratio(t: Tables) -> DataFrame:
    return c.imbalance_ratio(c.build_labels(t.bills))


@query(
    "X03 X05 D19 D11",
    """select Co_Ref, Renewal_Year, neg::bigint as total_negative_flags,
         case when neg <= 0 then '0' when neg <= 1 then '1' when neg <= 2 then '2'
           when neg <= 3 then '3' else '4+' end as flag_bucket,
         high_friction_score::bigint as high_friction_score
       from (select f.*, total_negative_flags
           + (case when b.Payment_Method = 'UNKNOWN' then 1 else 0 end)
           + (case when coalesce((b.Total_Net_Paid - b.Last_Total_Net_Paid) / b.Last_Total_Net_Paid, 0)
               > 0.1 then 1 else 0 end) as neg
         from features f join bills b on b.Co_Ref = f.Co_Ref and b.Renewal_Year = f.Renewal_Year)""",
    ["features", "bills"],
)
def build_profiling_table(t: Tables) -> DataFrame:
    df = build_profiling_features(t.bills, t.cc, t.rc)
    return df.select(
        "Co_Ref", "Renewal_Year",
        *_ints(df, ["total_negative_flags", "high_friction_score"]), "flag_bucket",
    )


# --- key sets ------------------------------------------------------------------------


@query(
    "O01",
    """select Co_Ref from cohort0 intersect
       select Co_Ref from rc where Co_Ref is not null""",
    ["cohort0", "rc"],
)
def key_intersection(t: Tables) -> DataFrame:
    return ks.key_intersection(c.cohort_rows(t.bills), t.rc.where("Co_Ref is not null"), ["Co_Ref"])


@query(
    "O02",
    """select distinct Co_Ref from cohort0 where Co_Ref not in (
         select Co_Ref from cc where Co_Ref is not null
         union all select Co_Ref from rc where Co_Ref is not null)""",
    ["cohort0", "cc", "rc"],
)
def key_difference(t: Tables) -> DataFrame:
    return ks.key_difference(c.cohort_rows(t.bills), t.cc, t.rc, key=["Co_Ref"])


@query(
    "W06",
    """select Co_Ref from (select distinct Co_Ref from bills where Co_Ref is not null)
       order by md5(concat(Co_Ref, '42')), Co_Ref limit 20""",
    ["bills"],
)
def sample_keys(t: Tables) -> DataFrame:
    return ks.sample_keys(t.bills)


@query(
    "M04 W03",
    """select Co_Ref, Renewal_Year, label, ((row_number() over (partition by label
         order by md5(concat(Co_Ref, '|', cast(Renewal_Year as varchar), '42'))) - 1) % 5)::integer
         as fold from decided""",
    ["decided"],
)
def stratified_folds(t: Tables) -> DataFrame:
    df = t.decided.select("Co_Ref", "Renewal_Year", "label")
    return ks.stratified_folds(df, "label", 5, ["Co_Ref", "Renewal_Year"])
