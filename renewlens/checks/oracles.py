"""SQL description of the stand-in tables and of the cleaned and derived tables built on them.

The registered queries are compared with SQL run on the same parquet tables by another engine. Each
oracle is a body over the common table expressions below.
"""

from __future__ import annotations

from collections.abc import Sequence


def yes_no(c: str) -> str:
    t = f"lower(trim({c}))"
    return (
        f"case when {t} in ('yes','y','true','1') then 'Yes' "
        f"when {t} in ('no','n','false','0','not discussed','not applicable') then 'No' end"
    )


def extract(c: str) -> str:
    t = f"lower(trim({c}))"
    head = f"substring({t}, 1, 30)"
    return (
        f"case when {t} in ('not applicable','not discussed','unavailable','xxxx','') then null "
        f"when {t} in ('no','[no]','**no**') then 'No' "
        f"when {t} like 'yes%' then 'Yes' when {t} like 'no%' then 'No' "
        f"when regexp_matches({head}, '\\byes\\b') then 'Yes' "
        f"when regexp_matches({head}, '\\bno\\b') then 'No' end"
    )


def flag(cond: str) -> str:
    return f"(case when {cond} then 1 else 0 end)"


def pct(cond: str) -> str:
    return f"avg(case when {cond} then 1.0::double else 0.0::double end) * 100"


def chi2_tail(x: str, dof: str) -> str:
    """Upper tail from the series of the lower incomplete gamma function."""
    return (
        f"(case when {x} <= 0 then 1.0 when {x} > 800 then 0.0 else 1.0 - list_sum(list_transform("
        f"range(0, 1500), lambda k: exp(-({x}) / 2 + ({dof} / 2.0 + k) * ln(({x}) / 2) "
        f"- lgamma({dof} / 2.0 + k + 1)))) end)"
    )


STANDIN = {
    "billings": """
  with j as (
    select o_custkey, o_orderkey, l_linenumber, o_orderdate, l_shipdate, o_orderstatus, o_totalprice,
      l_discount, l_quantity, l_returnflag, c_mktsegment, c_acctbal, year(o_orderdate) as yr,
      row_number() over (partition by o_custkey, year(o_orderdate)
        order by case when l_shipdate > o_orderdate then 0 else 1 end, l_shipdate, o_orderkey,
          l_linenumber, l_partkey, l_suppkey) as rn
    from orders join lineitem on l_orderkey = o_orderkey join customer on c_custkey = o_custkey),
  b as (select *, case when o_orderkey % 29 = 0 then null
      when c_mktsegment = 'AUTOMOBILE' then 'Band A' when c_mktsegment = 'BUILDING' then 'Band C1'
      when c_mktsegment = 'FURNITURE' then 'Group' when o_orderkey % 3 = 0 then 'Band F2'
      when o_orderkey % 3 = 1 then 'Band Z' else 'Band J' end as band from j where rn = 1)
  select o_custkey as Co_Ref, yr as Renewal_Year, o_orderdate as Prospect_Renewal_Date,
    l_shipdate as Closed_Date,
    case o_orderstatus when 'F' then 'Won' when 'P' then 'Churned' else 'Open' end as Prospect_Outcome,
    band as Band, lag(band) over (partition by o_custkey order by yr) as Last_Band,
    o_totalprice as Total_Net_Paid,
    lag(o_totalprice) over (partition by o_custkey order by yr) as Last_Total_Net_Paid,
    yr - min(yr) over (partition by o_custkey) as Tenure_Years,
    l_linenumber - 1 as Current_Anchorings, l_quantity as Connection_Qty,
    l_discount as Discount_Amount,
    case when o_orderkey % 13 = 0 then null when l_returnflag = 'A' then ' y '
      when l_returnflag = 'N' then 'n' when o_orderkey % 2 = 0 then 'yes' else 'Yes' end
      as Current_Auto_Renewal_Flag,
    case when o_orderkey % 11 = 0 then null else c_acctbal end as Renewal_Score_At_Release,
    case when o_orderkey % 5 = 0 then ' unknown' when o_orderkey % 5 = 1 then 'Card'
      else 'direct debit ' end as Payment_Method
  from b""",
    "cc_calls": """
  select user_id * 10 + event_id % 10 as Co_Ref, cast(1995 + event_id % 7 as int) as Call_Year,
    ts as Call_Date,
    case when event_type in ('click', 'view', 'error') then ' IN_BOUND' else 'OUT_BOUND ' end
      as Direction,
    case (event_id * 7 + 3) % 9 when 0 then 'Yes' when 1 then ' yes' when 2 then 'No'
      when 3 then 'Not Discussed' when 4 then null
      when 5 then 'The caller explained at length that it was unclear' when 6 then 'TRUE'
      when 7 then '0' else 'n' end as cc_contractor_suggest_leave,
    case (event_id * 5 + 1) % 8 when 0 then 'Yes' when 1 then null when 2 then 'Not applicable'
      else 'No' end as cc_contractor_complained,
    case when event_type = 'error' then 'Yes' else 'No' end as cc_platform_issues,
    case event_id % 6 when 0 then 'Satisfied' when 1 then 'Neutral' when 2 then 'Dissatisfied'
      when 3 then 'Not Discussed' when 4 then null else 'Customer began unhappy and then relaxed' end
      as cc_contractor_sentiment,
    case when event_id % 6 = 0 then 'Not Discussed' when event_id % 17 = 0 then null
      else cast((event_id * 37) % 101 as string) end as cc_contractor_sentiment_start_score,
    case when event_id % 10 = 0 then '' when event_id % 19 = 0 then 'n/k'
      else cast((event_id * 53) % 101 as string) end as cc_contractor_sentiment_end_score
  from events""",
    "renewal_calls": """
  select case when l_partkey % 97 = 0 then null else o_custkey end as Co_Ref,
    year(o_orderdate) as Call_Year, cast(l_linenumber as string) as Call_Number,
    case l_partkey % 6 when 0 then 'Outbound' when 1 then 'OUT_BOUND' when 2 then 'Inbound'
      when 3 then ' in_bound ' when 4 then null else 'transfer' end as Call_Direction,
    case (l_partkey * 3 + l_suppkey) % 14 when 0 then 'Yes (asked if the price could be dropped)'
      when 1 then '[No]' when 2 then '**no**' when 3 then 'Not applicable' when 4 then 'XXXX'
      when 5 then 'Customer said yes, but later' when 6 then 'Well, no thanks' when 7 then 'Not sure'
      when 8 then null when 9 then 'UNAVAILABLE' when 10 then 'Yes'
      when 11 then 'Yesterday it was raised' when 12 then 'A very long remark before the word yes'
      else 'No' end as Discount_or_Waiver_Requested,
    case when l_discount > 0.08 then 'Yes' else 'No' end as Explicit_Switching_Intent,
    case when l_tax > 0.06 then 'Yes' when l_tax < 0.01 then null else 'No' end
      as Explicit_Competitor_Mention,
    case l_returnflag when 'R' then 'Yes' else 'No' end as Call_Reschedule_Request,
    case when l_linestatus = 'F' then 'Yes/No' when l_quantity > 25 then 'Yes' else 'No' end
      as Membership_Renewal_Decision
  from lineitem join orders on o_orderkey = l_orderkey
  where (o_custkey + year(o_orderdate)) % 4 <> 0""",
    "emails": """
  select o_custkey as Co_Ref, year(o_orderdate) + 1 as year,
    case o_orderpriority when '1-URGENT' then 'pre_renewal' when '2-HIGH' then ' 14_out'
      when '3-MEDIUM' then '45_out ' else 'prior_year' end as Time_to_Renewal,
    case o_orderkey % 9 when 0 then 'Satisfied' when 1 then 'Neutral' when 2 then 'not discussed'
      when 3 then 'Dissatisfied' when 4 then 'Initially dissatisfied, later neutral' when 5 then 'Yes'
      when 6 then null when 7 then 'The contractor wrote a very long message about many things'
      else ' positive ' end as crm_contractor_sentiment,
    case when o_orderkey % 7 = 0 then 'none' else cast(o_orderkey % 5 as string) end
      as crm_agent_chase_count,
    case o_orderkey % 4 when 0 then 'Yes' when 1 then 'No' when 2 then 'Not Discussed' else null end
      as crm_customer_complained
  from orders""",
    "dates_raw": """
  select o_orderkey, o_orderdate, o_orderkey % 4 < 3 as parse_ok,
    case o_orderkey % 4
      when 0 then concat(lpad(cast(day(o_orderdate) as string), 2, '0'), '-',
        lpad(cast(month(o_orderdate) as string), 2, '0'), '-', cast(year(o_orderdate) as string))
      when 1 then concat(cast(day(o_orderdate) as string), '/',
        cast(month(o_orderdate) as string), '/', cast(year(o_orderdate) as string))
      when 2 then concat(cast(year(o_orderdate) as string), '-',
        lpad(cast(month(o_orderdate) as string), 2, '0'), '-',
        lpad(cast(day(o_orderdate) as string), 2, '0'))
      else 'unknown' end as date_raw
  from orders""",
}

_KEY = "nullif(trim(cast(Co_Ref as varchar)), '')"
_SENT = "lower(trim(crm_contractor_sentiment))"

DERIVED = {
    "bills": f"""
  select {_KEY} as Co_Ref, cast(Renewal_Year as integer) as Renewal_Year, Prospect_Renewal_Date,
    Closed_Date, trim(Prospect_Outcome) as Prospect_Outcome, trim(Band) as Band, Last_Band,
    Total_Net_Paid, Last_Total_Net_Paid, cast(Tenure_Years as double) as Tenure_Years,
    cast(Current_Anchorings as double) as Current_Anchorings, Connection_Qty, Discount_Amount,
    case when trim(Current_Auto_Renewal_Flag) in ('y','Y','yes') then 'Yes'
      when trim(Current_Auto_Renewal_Flag) in ('n','N','no') then 'No' end
      as Current_Auto_Renewal_Flag,
    Renewal_Score_At_Release, upper(trim(Payment_Method)) as Payment_Method
  from billings""",
    "cc": f"""
  select {_KEY} as Co_Ref, Call_Year, Call_Date, trim(Direction) as Direction,
    {yes_no('cc_contractor_suggest_leave')} as cc_contractor_suggest_leave,
    {yes_no('cc_contractor_complained')} as cc_contractor_complained,
    {yes_no('cc_platform_issues')} as cc_platform_issues,
    cc_contractor_sentiment,
    case when cc_contractor_sentiment in ('Satisfied','Neutral','Dissatisfied','Not Discussed')
      then cc_contractor_sentiment end as cc_contractor_sentiment_clean,
    try_cast(cc_contractor_sentiment_start_score as double) as start_score,
    try_cast(cc_contractor_sentiment_end_score as double) as end_score,
    try_cast(cc_contractor_sentiment_end_score as double)
      - try_cast(cc_contractor_sentiment_start_score as double) as sentiment_delta
  from cc_calls""",
    "rc": f"""
  select {_KEY} as Co_Ref, cast(Call_Year as integer) as Call_Year,
    try_cast(Call_Number as double) as Call_Number,
    case lower(trim(Call_Direction)) when 'outbound' then 'Outbound' when 'out_bound' then 'Outbound'
      when 'inbound' then 'Inbound' when 'in_bound' then 'Inbound' end as Call_Direction,
    {extract('Discount_or_Waiver_Requested')} as Discount_or_Waiver_Requested,
    {extract('Explicit_Switching_Intent')} as Explicit_Switching_Intent,
    {extract('Explicit_Competitor_Mention')} as Explicit_Competitor_Mention,
    {extract('Call_Reschedule_Request')} as Call_Reschedule_Request,
    nullif(Membership_Renewal_Decision, 'Yes/No') as Membership_Renewal_Decision
  from renewal_calls""",
    "em": f"""
  select {_KEY} as Co_Ref, cast(year as integer) as year, trim(Time_to_Renewal) as Time_to_Renewal,
    crm_contractor_sentiment,
    case when {_SENT} in ('satisfied','positive','initially dissatisfied, later satisfied')
        then 'Positive'
      when {_SENT} in ('neutral','not discussed','initially dissatisfied, later neutral')
        then 'Neutral'
      when {_SENT} in ('dissatisfied','negative') then 'Negative' end
      as crm_contractor_sentiment_clean,
    coalesce(try_cast(crm_agent_chase_count as double), 0) as crm_agent_chase_count,
    {yes_no('crm_customer_complained')} as crm_customer_complained
  from emails""",
    "cohort0": """
  select * from bills where Closed_Date > Prospect_Renewal_Date
    and Closed_Date <= Prospect_Renewal_Date + interval 28 day
    and Prospect_Outcome in ('Won', 'Churned')""",
    "bandmap": """
  select * from (values ('Group', 0), ('Band A', 1), ('Band B', 2), ('Band C1', 3), ('Band C2', 4),
    ('Band D', 5), ('Band E', 6), ('Band F', 7), ('Band F1', 8), ('Band F2', 9), ('Band G', 10),
    ('Band H', 11), ('Band I', 12), ('Band J', 13)) t(band_name, band_no)""",
    "cohort": f"""
  select c.*, {flag('Last_Total_Net_Paid is null')} as is_first_year,
    case when Current_Auto_Renewal_Flag = 'Yes' then 0 else 1 end as auto_renewal_off,
    {flag('Current_Anchorings = 0')} as anchoring_zero,
    {flag('Current_Anchorings >= 1')} as anchoring_1plus,
    {flag('Current_Anchorings >= 3')} as anchoring_3plus,
    coalesce(b.band_no, 0) as band_enc,
    {flag('coalesce(b.band_no, 0) < l.band_no')} as band_downgraded,
    {flag('coalesce(b.band_no, 0) > l.band_no')} as band_upgraded,
    {flag('Renewal_Score_At_Release < q25')} as low_release_score,
    {flag('Tenure_Years <= 1')} as tenure_0_1,
    {flag('Tenure_Years between 2 and 3')} as tenure_2_3,
    {flag('Tenure_Years between 4 and 7')} as tenure_4_7,
    {flag('Tenure_Years >= 8')} as tenure_8plus,
    {flag("Prospect_Outcome = 'Churned'")} as churn_label
  from cohort0 c left join bandmap b on b.band_name = c.Band
    left join bandmap l on l.band_name = c.Last_Band
    left join (select Renewal_Year as qy, quantile_cont(Renewal_Score_At_Release, 0.25) as q25
      from cohort0 group by 1) q on q.qy = c.Renewal_Year""",
    "ccf": f"""
  select Co_Ref, Call_Year as Renewal_Year, count(*) as cc_call_count,
    max({flag("cc_contractor_suggest_leave = 'Yes'")}) as cc_ever_suggest_leave,
    max({flag("cc_contractor_complained = 'Yes'")}) as cc_ever_complained,
    max({flag("cc_platform_issues = 'Yes'")}) as cc_ever_platform_issues,
    avg({flag("cc_contractor_sentiment_clean = 'Dissatisfied'")}) as cc_pct_dissatisfied,
    avg(sentiment_delta) as cc_avg_sentiment_delta,
    sum({flag("Direction = 'IN_BOUND'")})::bigint as cc_inbound_count
  from cc where Co_Ref is not null and Call_Year is not null group by 1, 2""",
    "rcf": f"""
  select Co_Ref, Call_Year as Renewal_Year, count(*) as rc_call_count,
    max(Call_Number) as rc_max_call_number,
    max({flag("Discount_or_Waiver_Requested = 'Yes'")}) as rc_discount_requested,
    max({flag("Explicit_Competitor_Mention = 'Yes'")}) as rc_competitor_mentioned,
    max({flag("Explicit_Switching_Intent = 'Yes'")}) as rc_switching_intent,
    max({flag("Call_Reschedule_Request = 'Yes'")}) as rc_rescheduled,
    sum({flag("Call_Direction = 'Outbound'")})::bigint as rc_outbound_count
  from rc where Co_Ref is not null and Call_Year is not null group by 1, 2""",
    "joined": """
  select c.Co_Ref, c.Renewal_Year, Band, Prospect_Outcome, churn_label,
    coalesce(Tenure_Years, 0) as Tenure_Years, coalesce(Current_Anchorings, 0) as Current_Anchorings,
    coalesce(Connection_Qty, 0) as Connection_Qty, coalesce(Discount_Amount, 0) as Discount_Amount,
    coalesce(Last_Total_Net_Paid, 0) as Last_Total_Net_Paid,
    coalesce(Renewal_Score_At_Release, 0) as Renewal_Score_At_Release,
    is_first_year, auto_renewal_off, anchoring_zero, anchoring_1plus, anchoring_3plus, band_enc,
    band_downgraded, band_upgraded, low_release_score, tenure_0_1, tenure_2_3, tenure_4_7,
    tenure_8plus,
    coalesce(cc_call_count, 0) as cc_call_count,
    coalesce(cc_ever_suggest_leave, 0) as cc_ever_suggest_leave,
    coalesce(cc_ever_complained, 0) as cc_ever_complained,
    coalesce(cc_ever_platform_issues, 0) as cc_ever_platform_issues,
    coalesce(cc_pct_dissatisfied, 0) as cc_pct_dissatisfied,
    coalesce(cc_avg_sentiment_delta, 0) as cc_avg_sentiment_delta,
    coalesce(cc_inbound_count, 0) as cc_inbound_count,
    coalesce(cc_inbound_count::double / cc_call_count, 0) as cc_inbound_ratio,
    case when cc_avg_sentiment_delta < 0 then 1 else 0 end as cc_sentiment_worsened,
    case when cc_call_count >= 3 then 1 else 0 end as cc_multiple_calls,
    coalesce(rc_call_count, 0) as rc_call_count,
    coalesce(rc_max_call_number, 0) as rc_max_call_number,
    coalesce(rc_discount_requested, 0) as rc_discount_requested,
    coalesce(rc_competitor_mentioned, 0) as rc_competitor_mentioned,
    coalesce(rc_switching_intent, 0) as rc_switching_intent,
    coalesce(rc_rescheduled, 0) as rc_rescheduled,
    coalesce(rc_outbound_count, 0) as rc_outbound_count,
    case when rc_max_call_number >= 3 then 1 else 0 end as rc_high_friction,
    case when rc_outbound_count >= 2 then 1 else 0 end as rc_agent_chased
  from cohort c left join ccf on ccf.Co_Ref = c.Co_Ref and ccf.Renewal_Year = c.Renewal_Year
    left join rcf on rcf.Co_Ref = c.Co_Ref and rcf.Renewal_Year = c.Renewal_Year""",
    "features": """
  select *, case when cc_ever_suggest_leave = 1 or rc_switching_intent = 1 then 1 else 0 end
      as any_leave_signal,
    rc_competitor_mentioned as any_competitor_signal, 0 as any_financial_hardship,
    cc_ever_complained as any_complaint,
    cc_ever_suggest_leave + cc_ever_complained + cc_ever_platform_issues + rc_discount_requested
      + rc_competitor_mentioned + rc_switching_intent + rc_rescheduled + auto_renewal_off
      + anchoring_zero as total_negative_flags,
    cc_call_count + rc_call_count as total_contact_count,
    case when cc_call_count + rc_call_count = 0 then 1 else 0 end as has_no_behavioural_data,
    (case when rc_max_call_number >= 3 then 1 else 0 end) + rc_discount_requested + rc_rescheduled
      + cc_multiple_calls as high_friction_score,
    auto_renewal_off * anchoring_zero as critical_risk_billing
  from joined""",
    "tested": """
  select f.*, p.price_increase_10pct, p.payment_unknown, coalesce(m.email_pct_negative, 0) as email_pct_negative
  from features f
  join (select Co_Ref, Renewal_Year, case when upper(Payment_Method) = 'UNKNOWN' then 1 else 0 end as payment_unknown,
      case when Last_Total_Net_Paid <> 0 and (Total_Net_Paid - Last_Total_Net_Paid) / Last_Total_Net_Paid > 0.1
        then 1 else 0 end as price_increase_10pct
    from cohort0) p on p.Co_Ref = f.Co_Ref and p.Renewal_Year = f.Renewal_Year
  left join (select Co_Ref, avg(case when crm_contractor_sentiment_clean = 'Negative' then 1 else 0 end) as email_pct_negative
    from em where Time_to_Renewal = 'prior_year' and Co_Ref is not null group by 1) m on m.Co_Ref = f.Co_Ref""",
    "decided": """
  select *, case when Prospect_Outcome = 'Churned' then 1 else 0 end as label,
    (Renewal_Score_At_Release + 1000) / 11000 as p,
    case when Last_Total_Net_Paid <> 0
      then (Total_Net_Paid - Last_Total_Net_Paid) / Last_Total_Net_Paid end as change
  from bills where Prospect_Outcome in ('Won', 'Churned')""",
    "scored": """
  select Co_Ref, Renewal_Year, p as score, label from decided where p is not null""",
    "ladder": """
  select score as t, sum(label)::bigint as n1, sum(1 - label)::bigint as n0,
    sum(sum(label)) over (order by score desc)::bigint as tp,
    sum(sum(1 - label)) over (order by score desc)::bigint as fp,
    sum(sum(label)) over ()::bigint as n_pos, sum(sum(1 - label)) over ()::bigint as n_neg
  from scored group by score""",
    "curve": """
  select *, tp::double / (tp + fp) as precision, tp::double / n_pos as recall,
    2 * (tp::double / (tp + fp)) * (tp::double / n_pos)
      / (tp::double / (tp + fp) + tp::double / n_pos + 1e-9) as f1
  from ladder""",
}

# which expressions a derived table reads
NEEDS = {
    "bills": ["billings"], "cc": ["cc_calls"], "rc": ["renewal_calls"], "em": ["emails"],
    "cohort0": ["bills"], "bandmap": [], "cohort": ["cohort0", "bandmap"], "ccf": ["cc"],
    "rcf": ["rc"], "joined": ["cohort", "ccf", "rcf"], "features": ["joined"],
    "tested": ["features", "cohort0", "em"],
    "decided": ["bills"], "scored": ["decided"], "ladder": ["scored"], "curve": ["ladder"],
}


def with_tables(body: str, *tables: str, floats: Sequence[str] = ()) -> str:
    """The body with the expressions it needs in front; listed columns are rounded to 6 digits."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in NEEDS.get(name, []):
            visit(need)
        order.append(name)

    for name in tables:
        visit(name)
    ctes = ",\n".join(f"{n} as ({(STANDIN | DERIVED)[n]}\n)" for n in order)
    if floats:
        repl = ", ".join(f'round(cast("{c}" as double), 6) + 0.0 as "{c}"' for c in floats)
        body = f"select * replace ({repl}) from (\n{body}\n) as result"
    elif body.lstrip().startswith("with"):
        body = f"select * from (\n{body}\n) as result"
    return f"with {ctes}\n{body}" if ctes else body
