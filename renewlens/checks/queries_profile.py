"""Profiles, counts, churn-rate tables, distributions, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens import schema as s
from renewlens.checks.oracles import pct
from renewlens.checks.registry import Tables, query
from renewlens.functions import buckets, scalars as fn
from renewlens.operators import behaviour as b
from renewlens.operators import cohort as c
from renewlens.operators import profiling as p
from renewlens.operators import sketches as sk
from renewlens.session import stage

CHURNED = "Prospect_Outcome = 'Churned'"
INVENTORY = {
    "Band": "string", "Current_Auto_Renewal_Flag": "string", "Last_Band": "string",
    "Last_Total_Net_Paid": "double", "Renewal_Score_At_Release": "double", "Renewal_Year": "int",
}
RC_YN = [
    "Discount_or_Waiver_Requested", "Explicit_Switching_Intent", "Explicit_Competitor_Mention",
    "Call_Reschedule_Request",
]
CC_YN = ["cc_contractor_suggest_leave", "cc_contractor_complained", "cc_platform_issues"]
LIFT = [
    "any_leave_signal", "any_competitor_signal", "any_complaint", "auto_renewal_off",
    "anchoring_zero", "has_no_behavioural_data",
]


def _union(parts: list[str]) -> str:
    return "\nunion all ".join(parts)


def _inventory(table: str, measure: str = "null_pct") -> str:
    return _union([
        f"""select '{col}' as "column", '{kind}' as dtype,
            sum(case when {col} is null then 1 else 0 end)::bigint as null_count,
            round(sum(case when {col} is null then 1 else 0 end) * 100.0::double / count(*), 2)
              as null_pct from {table}"""
        for col, kind in INVENTORY.items()
    ])


# --- inventories ------------------------------------------------------------------


@query("P01", _inventory("bills"), ["bills"], ["null_pct"])
def column_inventory(t: Tables) -> DataFrame:
    return p.column_inventory(t.bills, list(INVENTORY))


@query(
    "P02 O03",
    f"""select *, case when null_pct > 10 then 'high' when null_pct >= 5 then 'medium' else 'low' end
          as severity from ({_inventory('bills')}) where null_pct > 1""",
    ["bills"],
    ["null_pct"],
)
def null_ranking(t: Tables) -> DataFrame:
    return p.null_ranking(t.bills, 1.0, 10.0, 5.0, list(INVENTORY))


@query(
    "P42",
    f"""select "column", null_count from ({_inventory('bills')}) where null_count > 0""",
    ["bills"],
)
def null_check(t: Tables) -> DataFrame:
    return p.null_check(t.bills, list(INVENTORY))


@query(
    "P03",
    """select * from (values ('Call_Number')) v("column")
       where (select bool_and(try_cast(Call_Number as double) is not null) from renewal_calls
         where Call_Number is not null)""",
    ["renewal_calls"],
)
def numeric_stored_as_text(t: Tables) -> DataFrame:
    return p.numeric_stored_as_text(t.raw_rc)


@query(
    "P04",
    """select 'Co_Ref' as "column", 'id' as kind union all select 'Time_to_Renewal', 'id'
       union all select 'year', 'numeric' union all
       select 'crm_contractor_sentiment', case when count(*) <= 5 and bool_or(v = 'Yes')
         and bool_or(v = 'No') then 'yes_no' else 'free_text' end
         from (select distinct crm_contractor_sentiment as v from emails)
       union all select 'crm_agent_chase_count', case when bool_and(v in ('Yes', 'No'))
         then 'yes_no' else 'free_text' end
         from (select distinct crm_agent_chase_count as v from emails)
       union all select 'crm_customer_complained',
         case when bool_and(v in ('Yes', 'No', 'Not Discussed')) then 'yes_no' else 'free_text' end
         from (select distinct crm_customer_complained as v from emails)""",
    ["emails"],
)
def classify_columns(t: Tables) -> DataFrame:
    return p.classify_columns(t.raw_emails)


# --- counts -----------------------------------------------------------------------


@query(
    "P05",
    """select Payment_Method, count(*) as n, count(*)::double / sum(count(*)) over () as share
       from bills where Payment_Method is not null group by 1""",
    ["bills"],
    ["share"],
)
def value_counts(t: Tables) -> DataFrame:
    return p.value_counts(t.bills, "Payment_Method", normalize=True)


@query(
    "P05",
    "select Call_Direction, count(*) as n from rc group by 1",
    ["rc"],
)
def value_counts_with_null(t: Tables) -> DataFrame:
    return p.value_counts(t.rc, "Call_Direction", dropna=False)


@query(
    "P06",
    """select position, d.y as Call_Year, (select count(*) from cc where Call_Year = d.y) as n
       from (values (0, 1994), (1, 1995), (2, 1996), (3, 2050)) d(position, y)""",
    ["cc"],
)
def value_counts_ordered(t: Tables) -> DataFrame:
    return p.value_counts_ordered(t.cc, "Call_Year", [1994, 1995, 1996, 2050])


@query(
    "P07 O04",
    """select Band, count(*) as n from bills where Band is not null group by 1
       order by n desc, Band limit 5""",
    ["bills"],
)
def top_k_values(t: Tables) -> DataFrame:
    return p.top_k_values(t.bills, "Band", 5)


@query(
    "P08",
    """select Renewal_Year, count(*) filter (where Prospect_Outcome = 'Won') as "Won",
         count(*) filter (where Prospect_Outcome = 'Churned') as "Churned",
         count(*) filter (where Prospect_Outcome = 'Open') as "Open" from bills group by 1""",
    ["bills"],
)
def crosstab(t: Tables) -> DataFrame:
    return p.crosstab(t.bills, "Renewal_Year", "Prospect_Outcome", ["Won", "Churned", "Open"])


@query(
    "P09 W04",
    """select position, d.w as Time_to_Renewal, pos as "Positive", neu as "Neutral", neg as "Negative"
       from (values (0, 'prior_year'), (1, '45_out'), (2, '14_out'), (3, 'pre_renewal')) d(position, w)
       left join (select Time_to_Renewal,
           avg(case when crm_contractor_sentiment_clean = 'Positive' then 1.0 else 0 end) * 100 as pos,
           avg(case when crm_contractor_sentiment_clean = 'Neutral' then 1.0 else 0 end) * 100 as neu,
           avg(case when crm_contractor_sentiment_clean = 'Negative' then 1.0 else 0 end) * 100 as neg
         from em where crm_contractor_sentiment_clean is not null group by 1) e
         on e.Time_to_Renewal = d.w""",
    ["em"],
    ["Positive", "Neutral", "Negative"],
)
def crosstab_row_pct(t: Tables) -> DataFrame:
    return p.crosstab_row_pct(
        t.emails, "Time_to_Renewal", "crm_contractor_sentiment_clean",
        ["Positive", "Neutral", "Negative"], s.EMAIL_WINDOWS,
    )


@query(
    "P37",
    """select Call_Year, Membership_Renewal_Decision, count(*) as n from rc
       where Membership_Renewal_Decision is not null group by 1, 2""",
    ["rc"],
)
def count_by_two(t: Tables) -> DataFrame:
    return p.count_by_two(t.rc, "Call_Year", "Membership_Renewal_Decision")


@query(
    "P19",
    """select Call_Year, count(*) as n_rows, count(distinct Co_Ref) as n_keys from rc group by 1""",
    ["rc"],
)
def distinct_by_group(t: Tables) -> DataFrame:
    return p.distinct_by_group(t.rc, "Call_Year")


@query(
    "P21",
    """select Call_Year, Co_Ref, count(*) as n from cc where Co_Ref is not null group by 1, 2""",
    ["cc"],
)
def events_per_customer(t: Tables) -> DataFrame:
    return p.events_per_customer(t.cc, by=["Call_Year"])


@query(
    "P22",
    """select count(*) as customers, count(*) filter (where n = 1) as n_1,
         count(*) filter (where n >= 5) as n_5_plus, count(*) filter (where n >= 10) as n_10_plus,
         count(*) filter (where n >= 15) as n_15_plus, count(*) filter (where n >= 20) as n_20_plus
       from (select Co_Ref, count(*) as n from rc where Co_Ref is not null group by 1)""",
    ["rc"],
)
def tail_buckets(t: Tables) -> DataFrame:
    return p.tail_buckets(p.events_per_customer(t.rc))


@query(
    "P18",
    """select (select count(distinct Co_Ref) from em) as n_a,
         (select count(distinct Co_Ref) from bills) as n_b,
         (select count(*) from (select Co_Ref from em intersect select Co_Ref from bills)) as n_both,
         (select count(*) from (select Co_Ref from em intersect select Co_Ref from bills)) * 100.0
           / (select count(distinct Co_Ref) from bills) as coverage_pct""",
    ["em", "bills"],
    ["coverage_pct"],
)
def key_overlap(t: Tables) -> DataFrame:
    return p.key_overlap(t.emails, t.bills)


@query(
    "P18 P19",
    """select 'rc' as name, cast(Call_Year as varchar) as year, count(*) as n_rows, count(distinct Co_Ref) as n_keys
         from rc group by 2
       union all select 'rc', 'all', count(*), count(distinct Co_Ref) from rc
       union all select 'rc and cc', 'all', (select count(*) from rc),
         (select count(*) from (select Co_Ref from rc where Co_Ref is not null intersect select Co_Ref from cc))""",
    ["rc", "cc"],
)
def stored_key_sketches(t: Tables) -> DataFrame:
    """Keys of each year, of all years and common keys, from stored sketches; exact below 16,384 keys."""
    rc, cc = (stage(sk.key_sketches(df, ["Call_Year"])) for df in (t.rc, t.cc))
    total = sk.merge_keys(rc)
    both = total.join(sk.sketched_overlap(total, sk.merge_keys(cc)).select("n_both"))  # one row each
    row = lambda name, year, n: [F.lit(name).alias("name"), year.cast("string").alias("year"), "n_rows", n.alias("n_keys")]
    return (
        rc.select(*row("rc", F.col("Call_Year"), sk.distinct_keys()))
        .unionByName(total.select(*row("rc", F.lit("all"), sk.distinct_keys())))
        .unionByName(both.select(*row("rc and cc", F.lit("all"), F.col("n_both"))))
    )


@query("P20 P23 P24 E10")
def stored_value_sketches(t: Tables) -> DataFrame:
    """Quartiles of the scores per year and of all years, from stored sketches."""
    years = stage(sk.value_sketches(t.scored, ["Renewal_Year"], "score"))
    parts = [years.withColumn("year", F.col("Renewal_Year").cast("string")), sk.merge_values(years).withColumn("year", F.lit("all"))]
    cuts = [sk.sketched_quantile(q).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    return parts[0].select("year", "n_rows", *cuts).unionByName(parts[1].select("year", "n_rows", *cuts))


_COVERAGE = """select *,
      case when Co_Ref in (select Co_Ref from cc where Co_Ref is not null) then 1 else 0 end as has_cc,
      case when Co_Ref in (select Co_Ref from rc where Co_Ref is not null) then 1 else 0 end as has_rc
    from cohort0"""


@query(
    "P17",
    f"""select count(*) as n, sum(has_cc)::bigint as n_a, sum(has_rc)::bigint as n_b,
          sum(has_cc * has_rc)::bigint as n_both,
          sum((1 - has_cc) * (1 - has_rc))::bigint as n_none,
          avg(has_cc) * 100 as pct_a, avg(has_rc) * 100 as pct_b, avg(has_cc * has_rc) * 100 as pct_both,
          avg((1 - has_cc) * (1 - has_rc)) * 100 as pct_none from ({_COVERAGE})""",
    ["cohort0", "cc", "rc"],
    ["pct_a", "pct_b", "pct_both", "pct_none"],
)
def coverage_counts(t: Tables) -> DataFrame:
    flags = c.has_record_flags(
        c.cohort_rows(t.bills).select("Co_Ref"), {"has_cc": t.cc, "has_rc": t.rc}
    )
    return p.coverage_counts(flags)


@query(
    "P16 O05",
    f"""select 'has_cc' as source, has_cc as has_record, count(*) as n, {pct(CHURNED)} as churn_pct
          from ({_COVERAGE}) group by 2
        union all select 'has_rc', has_rc, count(*), {pct(CHURNED)} from ({_COVERAGE}) group by 2""",
    ["cohort0", "cc", "rc"],
    ["churn_pct"],
)
def rate_by_coverage(t: Tables) -> DataFrame:
    labels = c.build_labels(t.bills)
    flags = c.has_record_flags(labels, {"has_cc": t.cc, "has_rc": t.rc})
    return p.rate_by_coverage(flags, ["has_cc", "has_rc"])


# --- churn rates --------------------------------------------------------------------


@query(
    "P10",
    f"""select Band, count(*) as n, {pct(CHURNED)} as churn_pct from bills
        where Prospect_Outcome is distinct from 'Open' and Band is not null group by 1""",
    ["bills"],
    ["churn_pct"],
)
def churn_rate_by_band(t: Tables) -> DataFrame:
    return p.churn_rate_by(t.bills, "Band")


@query(
    "P10 D02",
    f"""select Renewal_Year, auto_renewal_off, count(*) as n, {pct(CHURNED)} as churn_pct
        from cohort group by 1, 2""",
    ["cohort"],
    ["churn_pct"],
)
def churn_rate_by_auto_renewal(t: Tables) -> DataFrame:
    rows = c.cohort_rows(t.bills).withColumn("auto_renewal_off", c.auto_renewal_off())
    return p.churn_rate_by(rows, ["Renewal_Year", "auto_renewal_off"])


@query(
    "P11",
    f"""select Renewal_Year, count(*) as n,
          count(*) filter (where Prospect_Outcome is distinct from 'Open') as n_decided,
          (sum(case when {CHURNED} then 1 else 0 end)::double
            / count(*) filter (where Prospect_Outcome is distinct from 'Open')) * 100 as churn_pct,
          {pct("Prospect_Outcome = 'Open'")} as open_pct from bills group by 1""",
    ["bills"],
    ["churn_pct", "open_pct"],
)
def outcome_rates_by_year(t: Tables) -> DataFrame:
    return p.outcome_rates_by_year(t.bills)


@query(
    "P12 D14",
    f"""select case when Tenure_Years <= -1 then null when Tenure_Years <= 1 then '0-1yr'
          when Tenure_Years <= 3 then '2-3yr' when Tenure_Years <= 7 then '4-7yr'
          when Tenure_Years <= 100 then '8+yr' end as bucket, count(*) as n,
          {pct(CHURNED)} as churn_pct from decided group by 1""",
    ["decided"],
    ["churn_pct"],
)
def churn_by_tenure_bucket(t: Tables) -> DataFrame:
    bucket = buckets.bucketize_right("Tenure_Years", *buckets.TENURE)
    return p.churn_by_bucket(t.decided, bucket, F.col("label"))


@query(
    "P12 D15",
    f"""select case when change <= -0.01 then 'Decreased' when change <= 0.01 then 'Flat'
          when change <= 0.1 then '1-10% up' else '>10% up' end as bucket, count(*) as n,
          {pct(CHURNED)} as churn_pct from decided where change is not null group by 1""",
    ["decided"],
    ["churn_pct"],
)
def churn_by_price_bucket(t: Tables) -> DataFrame:
    bucket = buckets.bucketize_right("change", *buckets.PRICE_4)
    return p.churn_by_bucket(t.decided, bucket, F.col("label"))


@query(
    "P13",
    f"""with e as (select list_sort(list_distinct(quantile_cont(Total_Net_Paid,
            [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) as edges from decided),
        x as (select greatest(len(list_filter(edges, lambda v: v < Total_Net_Paid)), 1) as bin, edges,
          label from decided, e where Total_Net_Paid is not null)
        select bin::integer as bin, min(edges[bin]) as lo, min(edges[bin + 1]) as hi, count(*) as n,
          avg(label::double) * 100 as churn_pct from x group by bin""",
    ["decided"],
    ["lo", "hi", "churn_pct"],
)
def churn_by_quantile(t: Tables) -> DataFrame:
    return p.churn_by_quantile(t.decided, "Total_Net_Paid", F.col("label"), 5)


@query(
    "P14",
    f"""select least(Current_Anchorings, 5) as capped, count(*) as n, {pct(CHURNED)} as churn_pct
        from decided where Current_Anchorings is not null group by 1""",
    ["decided"],
    ["capped", "churn_pct"],
)
def churn_by_capped_count(t: Tables) -> DataFrame:
    return p.churn_by_capped_count(t.decided, "Current_Anchorings", F.col("label"), 5.0)


@query(
    "P15",
    """select total_negative_flags::bigint as total_negative_flags, count(*) as n,
         avg(churn_label::double) * 100 as churn_pct from features group by 1
       having count(*) >= 20""",
    ["features"],
    ["churn_pct"],
)
def dose_response(t: Tables) -> DataFrame:
    df = t.features.withColumn(
        "total_negative_flags", F.col("total_negative_flags").cast("bigint")
    )
    return p.dose_response(df, "total_negative_flags", F.col("churn_label"))


@query(
    "P44",
    _union([
        f"""select '{f}' as "column", count(*) filter (where {f} = 1) as n,
            avg(case when {f} = 1 then churn_label::double end) * 100 as churn_pct from cohort"""
        for f in ("tenure_0_1", "tenure_2_3", "tenure_4_7", "anchoring_zero")
    ]),
    ["cohort"],
    ["churn_pct"],
)
def rate_by_onehot(t: Tables) -> DataFrame:
    rows = c.cohort_rows(t.bills).withColumns({
        **c.billing_flags(), "churn_label": fn.flag(F.col("Prospect_Outcome") == "Churned"),
    })
    return p.rate_by_onehot(rows, ["tenure_0_1", "tenure_2_3", "tenure_4_7", "anchoring_zero"])


@query(
    "P40",
    "select *, pct_1 / nullif(pct_0, 0) as lift from ("
    + _union([
        f"""select '{f}' as "column",
            avg(case when {f} = 0 then churn_label::double end) * 100 as pct_0,
            avg(case when {f} = 1 then churn_label::double end) * 100 as pct_1 from features"""
        for f in LIFT
    ]) + ")",
    ["features"],
    ["pct_0", "pct_1", "lift"],
)
def feature_lift(t: Tables) -> DataFrame:
    return p.feature_lift(t.features, LIFT)


# --- distributions --------------------------------------------------------------------

_DESC = ["Total_Net_Paid", "Connection_Qty", "Renewal_Score_At_Release", "Last_Total_Net_Paid"]


def _describe(col: str, group: str | None = None) -> str:
    lead = f"{group}, " if group else ""
    where = f"where {col} is not null" + (f" and {group} is not null" if group else "")
    tail = f" group by {group}" if group else ""
    return f"""select {lead}'{col}' as "column", count({col}) as "count", avg({col}) as mean,
        stddev_samp({col}) as std, min({col}) as "min", quantile_cont({col}, 0.25) as p25,
        quantile_cont({col}, 0.5) as p50, quantile_cont({col}, 0.75) as p75, max({col}) as "max"
        from bills {where}{tail}"""


_DFLOAT = ["mean", "std", "min", "p25", "p50", "p75", "max"]


@query("P20", _union([_describe(x) for x in _DESC]), ["bills"], _DFLOAT)
def describe(t: Tables) -> DataFrame:
    return p.describe(t.bills, _DESC)


@query(
    "P20",
    _union([_describe(x, "Prospect_Outcome") for x in _DESC[:2]]),
    ["bills"],
    _DFLOAT,
)
def describe_by_outcome(t: Tables) -> DataFrame:
    return p.describe(t.bills, _DESC[:2], by="Prospect_Outcome")


@query(
    "P23",
    """with r as (select min(Total_Net_Paid) as lo,
           (max(Total_Net_Paid) - min(Total_Net_Paid)) / 30 as step from bills)
       select bin, min(lo + bin * step) as lo, count(*) as n from (
         select least(len(list_filter(range(0, 30), lambda i: lo + i * step <= Total_Net_Paid)) - 1, 29)
           ::integer as bin, lo, step from bills, r where Total_Net_Paid is not null) group by 1""",
    ["bills"],
    ["lo"],
)
def histogram(t: Tables) -> DataFrame:
    return p.histogram(t.bills, "Total_Net_Paid", 30)


@query(
    "P24",
    """with q as (select Prospect_Outcome as g, quantile_cont(Total_Net_Paid, 0.25) as q1,
           quantile_cont(Total_Net_Paid, 0.5) as median, quantile_cont(Total_Net_Paid, 0.75) as q3
         from bills group by 1),
       x as (select *, Total_Net_Paid between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
         from bills join q on g = Prospect_Outcome)
       select Prospect_Outcome, count(*) as n, min(q1) as q1, min(median) as median, min(q3) as q3,
         min(case when inside then Total_Net_Paid end) as whisker_lo,
         max(case when inside then Total_Net_Paid end) as whisker_hi,
         sum(case when inside then 0 else 1 end)::bigint as n_outliers from x group by 1""",
    ["bills"],
    ["q1", "median", "q3", "whisker_lo", "whisker_hi"],
)
def box_stats(t: Tables) -> DataFrame:
    return p.box_stats(t.bills, "Total_Net_Paid", "Prospect_Outcome")


# --- flags ----------------------------------------------------------------------------


@query(
    "P25",
    _union([
        f"""select '{f}' as "column", sum(case when {f} = 'Yes' then 1 else 0 end)::bigint as yes_count,
            count({f}) as non_null,
            sum(case when {f} = 'Yes' then 1 else 0 end) * 100.0::double / greatest(count({f}), 1)
              as yes_pct from rc"""
        for f in RC_YN
    ]),
    ["rc"],
    ["yes_pct"],
)
def flag_prevalence(t: Tables) -> DataFrame:
    return p.flag_prevalence(t.rc, RC_YN)


@query(
    "P25 C22",
    _union([
        f"""select '{f}' as "column",
            sum(case when lower(trim({f})) = 'yes' then 1 else 0 end)::bigint as yes_count,
            count({f}) as non_null,
            sum(case when lower(trim({f})) = 'yes' then 1 else 0 end) * 100.0::double / count(*)
              as yes_pct from cc_calls"""
        for f in CC_YN
    ]),
    ["cc_calls"],
    ["yes_pct"],
)
def flag_prevalence_raw(t: Tables) -> DataFrame:
    return p.flag_prevalence(t.raw_cc, CC_YN, of_all_rows=True, loose=True)


@query(
    "P26",
    """select Time_to_Renewal, 'crm_customer_complained' as "column",
         sum(case when crm_customer_complained = 'Yes' then 1 else 0 end)::bigint as yes_count,
         count(crm_customer_complained) * 100.0::double / count(*) as populated_pct
       from em group by 1""",
    ["em"],
    ["populated_pct"],
)
def flag_by_window(t: Tables) -> DataFrame:
    return p.flag_by_window(t.emails, ["crm_customer_complained"])


@query(
    "P26",
    "select 'crm_customer_complained' as \"column\", " + ", ".join(
        f"""count(*) filter (where crm_customer_complained = 'Yes' and Time_to_Renewal = '{w}')
        as "{w}" """ for w in s.EMAIL_WINDOWS
    ) + "from em",
    ["em"],
)
def flag_by_window_wide(t: Tables) -> DataFrame:
    return p.flag_by_window_wide(t.emails, ["crm_customer_complained"])


@query(
    "P30",
    """with x as (select case when lower(trim(cc_platform_issues)) = 'yes' then 1 else 0 end as g,
         case when lower(trim(cc_contractor_suggest_leave)) = 'yes' then 100.0 else 0.0 end as v
         from cc_calls)
       select sum(g)::bigint as n_given, avg(case when g = 1 then v end) as p_given,
         avg(case when g = 0 then v end) as p_not_given,
         avg(case when g = 1 then v end) - avg(case when g = 0 then v end) as uplift from x""",
    ["cc_calls"],
    ["p_given", "p_not_given", "uplift"],
)
def conditional_rate(t: Tables) -> DataFrame:
    return p.conditional_rate(
        t.raw_cc,
        fn.is_yes_loose("cc_platform_issues") == 1,
        fn.is_yes_loose("cc_contractor_suggest_leave") == 1,
    )


_DIRECTION = f"""select upper(trim(Direction)) as direction, count(*) as call_count,
      {pct("lower(trim(cc_contractor_complained)) = 'yes'")} as complaint_rate,
      0.0::double as dissatisfaction_rate,
      {pct("lower(trim(cc_contractor_suggest_leave)) = 'yes'")} as suggest_leave_rate,
      {pct('try_cast(cc_contractor_sentiment_end_score as double) '
           '< try_cast(cc_contractor_sentiment_start_score as double)')} as worsened_sentiment_rate
    from cc_calls where upper(trim(Direction)) in ('IN_BOUND', 'OUT_BOUND') group by 1"""
_RATES = ["complaint_rate", "dissatisfaction_rate", "suggest_leave_rate", "worsened_sentiment_rate"]


def _raw_cc_full(t: Tables) -> DataFrame:
    from renewlens.operators.cleaning import conform

    return conform(t.raw_cc, s.CC_COLUMNS)


@query("P31", _DIRECTION, ["cc_calls"], _RATES)
def risk_by_direction(t: Tables) -> DataFrame:
    return p.risk_by_direction(_raw_cc_full(t))


@query(
    "P32",
    f"""select direction, metric, value from (unpivot ({_DIRECTION})
        on {', '.join(_RATES)} into name metric value value)""",
    ["cc_calls"],
    ["value"],
)
def melt(t: Tables) -> DataFrame:
    return p.melt(p.risk_by_direction(_raw_cc_full(t)), ["direction"], _RATES)


_DELTA = _union([
    f"""select '{f}' as "column", upper(trim({f})) as flag_value, avg(d) as avg_delta,
        count(*) as calls from (select *, try_cast(cc_contractor_sentiment_end_score as double)
          - try_cast(cc_contractor_sentiment_start_score as double) as d from cc_calls)
        where d is not null and upper(trim({f})) in ('YES', 'NO') group by 2"""
    for f in CC_YN
])


def _with_delta(t: Tables) -> DataFrame:
    delta = fn.to_number("cc_contractor_sentiment_end_score") - fn.to_number(
        "cc_contractor_sentiment_start_score"
    )
    return t.raw_cc.withColumn("sentiment_delta", delta)


@query("P33", _DELTA, ["cc_calls"], ["avg_delta"])
def delta_by_flag(t: Tables) -> DataFrame:
    return p.delta_by_flag(_with_delta(t), CC_YN)


@query("P33", f"select * from ({_DELTA}) where avg_delta < 0", ["cc_calls"], ["avg_delta"])
def flags_that_end_worse(t: Tables) -> DataFrame:
    return p.ends_worse(p.delta_by_flag(_with_delta(t), CC_YN))


@query(
    "P34",
    f"""select "column", max(case when flag_value = 'YES' then avg_delta end) as avg_delta_yes,
          max(case when flag_value = 'NO' then avg_delta end) as avg_delta_no,
          max(case when flag_value = 'YES' then calls end) as calls_yes,
          max(case when flag_value = 'NO' then calls end) as calls_no from ({_DELTA}) group by 1""",
    ["cc_calls"],
    ["avg_delta_yes", "avg_delta_no"],
)
def pivot_yes_no(t: Tables) -> DataFrame:
    return p.pivot_yes_no(p.delta_by_flag(_with_delta(t), CC_YN))


@query(
    "P35",
    f"""select Direction, count(*) as scored, {pct('sentiment_delta > 0')} as improved_pct,
          {pct('sentiment_delta < 0')} as worse_pct, {pct('sentiment_delta = 0')} as flat_pct,
          avg(sentiment_delta) as avg_delta from cc where sentiment_delta is not null group by 1""",
    ["cc"],
    ["improved_pct", "worse_pct", "flat_pct", "avg_delta"],
)
def delta_shares(t: Tables) -> DataFrame:
    return p.delta_shares(
        t.cc.withColumn("sentiment_delta", b.sentiment_delta()), by="Direction"
    )


@query(
    "P36",
    """select crm_contractor_sentiment_clean, avg(crm_agent_chase_count) as mean,
         count(crm_agent_chase_count) as n from em
       where crm_contractor_sentiment_clean is not null group by 1""",
    ["em"],
    ["mean"],
)
def mean_by_group(t: Tables) -> DataFrame:
    return p.mean_by_group(t.emails, "crm_contractor_sentiment_clean", "crm_agent_chase_count")


@query(
    "P38 C24 W04",
    """select month(Call_Date)::integer as month, Direction, count(*) as n,
         (sum(count(*)) over (partition by month(Call_Date)))::bigint as month_n,
         count(*)::double / sum(count(*)) over (partition by month(Call_Date)) as share
       from cc group by 1, 2, month(Call_Date)""",
    ["cc"],
    ["share"],
)
def monthly_rate(t: Tables) -> DataFrame:
    return p.monthly_rate(t.cc, fn.month_of("Call_Date"), "Direction")


@query(
    "P39",
    """with g as (select Renewal_Year as v, count(*) as n from bills group by 1)
       select (select v from g order by n desc, v limit 1) as peak, (select max(n) from g) as peak_n,
         (select v from g order by n, v limit 1) as low, (select min(n) from g) as low_n""",
    ["bills"],
)
def peak_and_low(t: Tables) -> DataFrame:
    return p.peak_and_low(t.bills, "Renewal_Year")


@query(
    "P41",
    f"""select count(*) as n, {pct('Current_Anchorings = 0')} as zero_anchorings_pct,
          {pct('Total_Net_Paid > Last_Total_Net_Paid')} as price_up_pct from bills
        where Last_Total_Net_Paid is not null""",
    ["bills"],
    ["zero_anchorings_pct", "price_up_pct"],
)
def share_over(t: Tables) -> DataFrame:
    return p.share_over(
        t.bills,
        {
            "zero_anchorings_pct": F.col("Current_Anchorings") == 0,
            "price_up_pct": F.col("Total_Net_Paid") > F.col("Last_Total_Net_Paid"),
        },
        F.col("Last_Total_Net_Paid").isNotNull(),
    )


# --- correlation -------------------------------------------------------------------------

_CORR = ["Total_Net_Paid", "Last_Total_Net_Paid", "Tenure_Years", "Current_Anchorings",
         "Connection_Qty", "Renewal_Score_At_Release"]


def _corr_sql(cols: list[str], table: str) -> str:
    return _union([
        f"""select '{x}' as a, '{y}' as b, count(*) as n, corr({x}, {y}) as r from {table}
            where {x} is not null and {y} is not null"""
        for i, x in enumerate(cols) for y in cols[i + 1:]
    ])


@query("P27", _corr_sql(_CORR, "bills"), ["bills"], ["r"])
def correlation_matrix(t: Tables) -> DataFrame:
    return p.correlation_matrix(t.bills, _CORR)


_WIDE = [
    "Tenure_Years", "Current_Anchorings", "Connection_Qty", "Discount_Amount", "Last_Total_Net_Paid",
    "Renewal_Score_At_Release", "is_first_year", "auto_renewal_off", "anchoring_zero", "band_enc",
    "cc_call_count", "rc_call_count", "total_negative_flags", "total_contact_count",
]


@query("P27", _corr_sql(_WIDE, "features"), ["features"], ["r"])
def correlation_matrix_wide(t: Tables) -> DataFrame:
    return p.correlation_matrix(t.features, _WIDE)


_HARD = {
    "paid": "Total_Net_Paid", "offset": "1e9 + Tenure_Years", "fixed": "0.1 + 0 * Total_Net_Paid",
    "holes": "case when Tenure_Years % 3 = 1 then cast('NaN' as double) else Total_Net_Paid end",
    "gaps": "case when Tenure_Years > 0 then Last_Total_Net_Paid end",
}


@query(
    "P27",
    _union([
        f"""select '{x}' as a, '{y}' as b, count(*) as n,
              {"null::double" if "fixed" in (x, y) else f'corr("{x}", "{y}")'} as r
            from (select {", ".join(f'({e})::double as "{c}"' for c, e in _HARD.items())} from bills)
            where not isnan(coalesce("{x}", 'NaN'::double)) and not isnan(coalesce("{y}", 'NaN'::double))"""
        for i, x in enumerate(_HARD) for y in list(_HARD)[i + 1:]
    ]),
    ["bills"],
    ["r"],
)
def correlation_hard_columns(t: Tables) -> DataFrame:
    """NaN, nulls, a constant and a large offset."""
    df = t.bills.select(*[F.expr(e).cast("double").alias(c) for c, e in _HARD.items()])
    return p.correlation_matrix(df, list(_HARD))


@query(
    "P28",
    _union([
        f"""select '{x}' as "column", count(*) as n, corr({x}, y) as r, abs(corr({x}, y)) as abs_r
            from (select *, case when Prospect_Outcome is distinct from 'Open' then
              case when Prospect_Outcome = 'Churned' then 1 else 0 end end as y from bills)
            where {x} is not null and y is not null"""
        for x in _CORR
    ]),
    ["bills"],
    ["r", "abs_r"],
)
def target_correlation(t: Tables) -> DataFrame:
    df = t.bills.withColumn("y", p.churn_target())
    return p.target_correlation(df, "y", _CORR)


@query(
    "P28",
    "select * from (" + _union([
        f"""select '{x}' as "column", count(*) as n, corr({x}, churn_label) as r,
            abs(corr({x}, churn_label)) as abs_r from features"""
        for x in _WIDE
    ]) + ') order by abs_r desc, "column" limit 5',
    ["features"],
    ["r", "abs_r"],
)
def strongest_correlations(t: Tables) -> DataFrame:
    return p.strongest(p.target_correlation(t.features, "churn_label", _WIDE), 5)


@query(
    "P29",
    f"select * from ({_corr_sql(_WIDE, 'features')}) where abs(r) > 0.7",
    ["features"],
    ["r"],
)
def collinear_pairs(t: Tables) -> DataFrame:
    return p.collinear_pairs(t.features, _WIDE)
