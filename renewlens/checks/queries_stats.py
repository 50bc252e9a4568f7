"""Ladder, thresholds, tiers, statistical tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens import schema as sc
from renewlens.checks.oracles import chi2_tail
from renewlens.checks.registry import Tables, query
from renewlens.operators import evaluation as e
from renewlens.operators import stattests as st
from renewlens.operators.ladder import class_ladder, quantiles
from renewlens.plans.hypotheses import hypothesis_features, hypothesis_summary

CHI_FEATURES = ["auto_renewal_off", "anchoring_zero", "any_leave_signal", "band_enc"]
RANK_FEATURES = ["Tenure_Years", "total_negative_flags", "Connection_Qty"]


def _union(parts: list[str]) -> str:
    return "\nunion all ".join(parts)


# --- ladder and curves -------------------------------------------------------------


@query(
    "E01 W01 W02",
    """select score as value, n0::bigint as n_0, n1::bigint as n_1,
         (sum(n0) over (order by score))::bigint as cum_0,
         (sum(n1) over (order by score))::bigint as cum_1, (sum(n0) over ())::bigint as tot_0,
         (sum(n1) over ())::bigint as tot_1 from (
           select score, sum(1 - label) as n0, sum(label) as n1 from scored group by 1)""",
    ["scored"],
)
def score_ladder(t: Tables) -> DataFrame:
    return class_ladder(t.scored, "score", "label")


@query(
    "E01 W01",
    """select Renewal_Year, score as value, n0 as n_0, n1 as n_1,
         (sum(n1) over (partition by Renewal_Year order by score))::bigint as cum_1,
         (sum(n1) over (partition by Renewal_Year))::bigint as tot_1 from (
           select Renewal_Year, score, sum(1 - label)::bigint as n0, sum(label)::bigint as n1
           from scored group by 1, 2)""",
    ["scored"],
)
def score_ladder_by_year(t: Tables) -> DataFrame:
    return class_ladder(t.scored, "score", "label", ["Renewal_Year"]).drop("cum_0", "tot_0")


@query(
    "E10 P20",
    """select Renewal_Year, count(score) as n, quantile_cont(score, 0.9) as p90,
         quantile_cont(score, 0.5) as p50, quantile_cont(score, 0.01) as p01
       from scored group by 1""",
    ["scored"],
    ["p90", "p50", "p01"],
)
def exact_quantiles(t: Tables) -> DataFrame:
    return quantiles(
        t.scored, "score", {"p90": 0.9, "p50": 0.5, "p01": 0.01}, ["Renewal_Year"]
    )


@query(
    "E02",
    """select t as threshold, precision, recall from curve
       union all select null, 1.0, 0.0""",
    ["curve"],
    ["precision", "recall"],
)
def pr_curve(t: Tables) -> DataFrame:
    return e.pr_curve(t.scored, "score", "label")


@query(
    "E04",
    """select t as threshold, fp::double / n_neg as fpr, tp::double / n_pos as tpr from ladder
       union all select null, 0.0, 0.0""",
    ["ladder"],
    ["fpr", "tpr"],
)
def roc_curve(t: Tables) -> DataFrame:
    return e.roc_curve(t.scored, "score", "label")


@query(
    "E03 E04",
    """select sum(n1::double / n_pos * tp / (tp + fp)) as average_precision,
         1 - sum(n0 * ((n_pos - tp) + n1 / 2.0)) / (max(n_pos)::double * max(n_neg)) as roc_auc
       from ladder""",
    ["ladder"],
    ["average_precision", "roc_auc"],
)
def ranking_metrics(t: Tables) -> DataFrame:
    return e.ranking_metrics(t.scored, "score", "label")


@query(
    "E05",
    """select t as threshold, precision, recall, f1 from curve order by f1 desc, t limit 1""",
    ["curve"],
    ["threshold", "precision", "recall", "f1"],
)
def best_f1_threshold(t: Tables) -> DataFrame:
    return e.best_f1_threshold(t.scored, "score", "label")


@query(
    "E06",
    """select coalesce((select t from curve where precision >= 0.02 and recall >= 0.5
         order by f1 desc, t limit 1), 0.3) as threshold""",
    ["curve"],
    ["threshold"],
)
def constrained_threshold(t: Tables) -> DataFrame:
    return e.constrained_threshold(t.scored, "score", "label", 0.02, 0.5)


@query(
    "E06",
    """select coalesce((select t from curve where precision >= 0.99 and recall >= 0.99
         order by f1 desc, t limit 1), 0.3) as threshold""",
    ["curve"],
    ["threshold"],
)
def constrained_threshold_fallback(t: Tables) -> DataFrame:
    return e.constrained_threshold(t.scored, "score", "label", 0.99, 0.99)


_CONFUSION = """select count(*) as n, sum(flagged * label)::bigint as tp,
      sum(flagged * (1 - label))::bigint as fp, sum((1 - flagged) * (1 - label))::bigint as tn,
      sum((1 - flagged) * label)::bigint as fn
    from (select label, case when score >= 0.5 then 1 else 0 end as flagged from scored)"""


@query(
    "E07",
    f"""select *, tp + fp as flagged, tp + fn as actual, tp as caught, fn as missed
        from ({_CONFUSION})""",
    ["scored"],
)
def confusion_counts(t: Tables) -> DataFrame:
    return e.confusion_counts(t.scored, "score", "label", 0.5)


@query(
    "E08",
    f"""with c as (select *, tp::double / (tp + fp) as p1, tp::double / (tp + fn) as r1,
          tn::double / (tn + fn) as p0, tn::double / (tn + fp) as r0,
          2.0 * tp / (2 * tp + fp + fn) as f1, 2.0 * tn / (2 * tn + fp + fn) as f0 from ({_CONFUSION}))
        select 'Retained' as name, p0 as precision, r0 as recall, f0 as f1, tn + fp as support from c
        union all select 'Churned', p1, r1, f1, tp + fn from c
        union all select 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n from c
        union all select 'weighted avg', (p0 * (tn + fp) + p1 * (tp + fn)) / n,
          (r0 * (tn + fp) + r1 * (tp + fn)) / n, (f0 * (tn + fp) + f1 * (tp + fn)) / n, n from c""",
    ["scored"],
    ["precision", "recall", "f1"],
)
def classification_report(t: Tables) -> DataFrame:
    return e.classification_report(t.scored, "score", "label", 0.5)


@query(
    "E08",
    f"""select Renewal_Year, n, tp, fp, tn, fn, coalesce(tp / nullif(tp + fp, 0), 0) as precision,
          coalesce(tp / nullif(tp + fn, 0), 0) as recall,
          coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1 from (
        {_CONFUSION.replace('select count(*)', 'select Renewal_Year, count(*)')
                   .replace('select label', 'select Renewal_Year, label')} group by 1)""",
    ["scored"],
    ["precision", "recall", "f1"],
)
def classification_metrics_by_year(t: Tables) -> DataFrame:
    return e.classification_metrics(t.scored, "score", "label", 0.5, ["Renewal_Year"]).drop(
        "flagged", "actual", "caught", "missed"
    )


@query(
    "E09",
    """select round(th, 2) as threshold, round(coalesce(caught::double / nullif(flagged, 0), 0), 3) as precision,
         round(coalesce(caught::double / nullif(actual, 0), 0), 3) as recall,
         round(coalesce(2.0 * caught / nullif(flagged + actual, 0), 0), 3) as f1, flagged, caught
       from (select th, sum(case when score >= th then 1 else 0 end)::bigint as flagged,
           sum(case when score >= th then label else 0 end)::bigint as caught,
           sum(label)::bigint as actual
         from scored, (select 0.05::double + 0.05::double * i as th from range(10) g(i))
         group by th)""",
    ["scored"],
    ["threshold", "precision", "recall", "f1"],
)
def threshold_table(t: Tables) -> DataFrame:
    return e.threshold_table(t.scored, "score", "label")


_TIER = """select Co_Ref, Renewal_Year, label, score, case when score >= p90 then 'Critical'
      when score >= p70 then 'High' when score >= p40 then 'Medium' else 'Low' end as risk_tier,
      case when score >= 0.6 then 1 else 0 end as churn_flag
    from scored, (select quantile_cont(score, 0.9) as p90, quantile_cont(score, 0.7) as p70,
      quantile_cont(score, 0.4) as p40 from scored)"""


@query(
    "E10 E11",
    f"select Co_Ref, Renewal_Year, risk_tier, churn_flag from ({_TIER})",
    ["scored"],
)
def risk_tier(t: Tables) -> DataFrame:
    return e.risk_tier(t.scored, "score").select(
        "Co_Ref", "Renewal_Year", "risk_tier", e.churn_flag("score", 0.6).alias("churn_flag")
    )


@query(
    "E14",
    f"""select risk_tier, count(*) as n, sum(churn_flag)::bigint as flagged from ({_TIER})
        group by 1""",
    ["scored"],
)
def tier_distribution(t: Tables) -> DataFrame:
    tiers = e.risk_tier(t.scored, "score").withColumn("churn_flag", e.churn_flag("score", 0.6))
    return e.tier_distribution(tiers)


@query(
    "E12",
    """select (len(list_filter(range(0, 10), lambda i: i * 0.1::double <= score)) - 1)::integer as bin,
         avg(score) as mean_score,
         avg(label::double) as actual_rate, count(*) as n from scored
       where score >= 0 and score < 1 group by 1""",
    ["scored"],
    ["mean_score", "actual_rate"],
)
def calibration_table(t: Tables) -> DataFrame:
    return e.calibration_table(t.scored, "score", "label")


@query(
    "E13",
    """with r as (select label as y, min(score) as lo, (max(score) - min(score)) / 50 as step,
         count(*) as total from scored group by 1)
       select label, bin, min(lo + bin * step) as lo, count(*) as n,
         count(*) / max(total)::double / max(step) as density from (
         select *, least(len(list_filter(range(0, 50), lambda i: lo + i * step <= score)) - 1, 49)::integer
           as bin from scored join r on y = label) group by label, bin""",
    ["scored"],
    ["lo", "density"],
)
def score_histogram_by_label(t: Tables) -> DataFrame:
    return e.score_histogram_by_label(t.scored, "score", "label")


@query(
    "E15",
    """select t as threshold, ap as pr_auc, auc as roc_auc, precision, recall,
         2.0 * tp / (2 * tp + fp + (n_pos - tp)) as f1, tp + fp as n_flagged,
         n_pos as n_actual_churn, n_pos + n_neg as n_test, tp as caught_churners,
         n_pos - tp as missed_churners
       from curve, (select sum(n1::double / n_pos * tp / (tp + fp)) as ap,
           1 - sum(n0 * ((n_pos - tp) + n1 / 2.0)) / (max(n_pos)::double * max(n_neg)) as auc
         from ladder)
       order by curve.f1 desc, t limit 1""",
    ["curve"],
    ["threshold", "pr_auc", "roc_auc", "precision", "recall", "f1"],
)
def evaluate(t: Tables) -> DataFrame:
    return e.evaluate(t.scored, "score", "label")


# --- tests ------------------------------------------------------------------------


def _chi_sql(feature: str, table: str = "features") -> str:
    return f"""
      select '{feature}' as feature, (select count(*) from {table}) as n_rows, chi2,
        ((r - 1) * (c - 1))::integer as dof, {chi2_tail('chi2', '((r - 1) * (c - 1))')} as p_value,
        sqrt(chi2 / ((select count(*) from {table}) * (least(r, c) - 1))) as cramers_v from (
        select sum(case when (r - 1) * (c - 1) = 1
              then greatest(abs(o - ex) - 0.5, 0) ^ 2 / ex else (o - ex) ^ 2 / ex end) as chi2,
          max(r) as r, max(c) as c from (
          select o, rt::double * ct / n as ex, r, c from (
            select g.v, l.y, coalesce(k.o, 0) as o, g.rt, l.ct, (select count(*) from {table}) as n,
              (select count(distinct {feature}) from {table}) as r,
              (select count(distinct churn_label) from {table}) as c
            from (select {feature} as v, count(*) as rt from {table} group by 1) g
              cross join (select churn_label as y, count(*) as ct from {table} group by 1) l
              left join (select {feature} as v, churn_label as y, count(*) as o from {table}
                group by 1, 2) k on k.v = g.v and k.y = l.y)))"""


_CHI = f"select *, p_value < 0.05 as significant from ({_union([_chi_sql(f) for f in CHI_FEATURES])})"


@query("T01 T02", _CHI, ["features"], ["chi2", "p_value", "cramers_v"])
def chi_square_tests(t: Tables) -> DataFrame:
    return st.chi_square_tests(t.features, CHI_FEATURES)


def _mw_sql(feature: str, table: str = "features") -> str:
    return f"""
      select '{feature}' as feature, n0 as n_0, n1 as n_1, u as u_statistic,
        (greatest(u, n0 * n1 - u) - n0 * n1 / 2.0 - 0.5)
          / sqrt(n0 * n1 / 12.0 * ((n + 1.0) - ties / (n * (n - 1.0)))) as z,
        abs(u - n0 * n1 / 2.0) / sqrt(n0 * n1 * (n + 1.0) / 12.0) / sqrt(n) as effect_size_r,
        m0 as mean_0, m1 as mean_1 from (
        select sum(r) filter (where y = 0) - max(n0) * (max(n0) + 1) / 2.0 as u,
          max(n0)::bigint as n0, max(n1)::bigint as n1, max(n0 + n1)::double as n,
          max(ties) as ties, avg(v) filter (where y = 0) as m0, avg(v) filter (where y = 1) as m1
        from (
          select v::double as v, y,
            rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as r,
            sum(1 - y) over () as n0, sum(y) over () as n1,
            sum(case when k = 1 then cnt * cnt * cnt - cnt else 0 end) over () as ties
          from (select {feature} as v, churn_label as y,
              row_number() over (partition by {feature}) as k,
              (count(*) over (partition by {feature}))::double as cnt
            from {table} where {feature} is not null)))"""


_MW = f"""select *, p_value < 0.05 as significant from (
    select *, {chi2_tail('z * z', '1')} as p_value
    from ({_union([_mw_sql(f) for f in RANK_FEATURES])}))"""
_MWF = ["u_statistic", "z", "effect_size_r", "mean_0", "mean_1", "p_value"]


@query("T03 T04 W01", _MW, ["features"], _MWF)
def mann_whitney_tests(t: Tables) -> DataFrame:
    return st.mann_whitney_tests(t.features, RANK_FEATURES)


def _ks_sql(feature: str) -> str:
    return f"""
      select '{feature}' as feature, max(na)::bigint as n_a, max(nb)::bigint as n_b,
        max(abs(fa - fb)) as ks_stat, max(ma) as mean_a, max(mb) as mean_b from (
        select v, sum(a) over (order by v) / sum(a) over () as fa,
          sum(b) over (order by v) / sum(b) over () as fb, sum(a) over () as na, sum(b) over () as nb,
          sum(a * v) over () / sum(a) over () as ma, sum(b * v) over () / sum(b) over () as mb
        from (select {feature}::double as v, sum(case when Renewal_Year <= 1997 then 1.0 else 0 end) as a,
            sum(case when Renewal_Year > 1997 then 1.0 else 0 end) as b from features group by 1))"""


_KS_P = """(case when x < 0.2 then 1.0 else least(greatest(2 * list_sum(list_transform(range(1, 101),
    lambda k: (case when k % 2 = 1 then 1 else -1 end) * exp(-2.0 * k * k * x * x))), 0), 1) end)"""
DRIFT = ["Tenure_Years", "Connection_Qty", "rc_call_count", "auto_renewal_off"]


@query(
    "T05 T06",
    f"""select * exclude (x), {_KS_P} as ks_p, {_KS_P} < 0.01 as shifted from (
          select *, ks_stat * sqrt(n_a::double * n_b / (n_a + n_b)) as x
          from ({_union([_ks_sql(f) for f in DRIFT])}))""",
    ["features"],
    ["ks_stat", "mean_a", "mean_b", "ks_p"],
)
def drift_report(t: Tables) -> DataFrame:
    from renewlens.session import stage

    features = stage(t.features)
    return st.drift_report(
        features.where("Renewal_Year <= 1997"), features.where("Renewal_Year > 1997"), DRIFT
    )


_TESTED = {feature: (name, kind) for name, feature, kind in sc.HYPOTHESES}
_NAME = "case feature " + " ".join(f"when '{f}' then '{n}'" for f, (n, _) in _TESTED.items()) + " end"
_BINARY, _RANKED = ([f for f, (_, kind) in _TESTED.items() if kind == k] for k in ("Chi-square", "Mann-Whitney"))


@query(
    "T07 S11 O05",
    f"""select {_NAME} as hypothesis, feature, 'Chi-square' as test, round(p_value, 6) as p_value,
          round(cramers_v, 4) as effect_size, round(pct_0, 1) as churn_if_0,
          round(pct_1, 1) as churn_if_1, round(pct_1 / nullif(pct_0, 0), 2) as lift,
          null::double as mean_retained, null::double as mean_churned, p_value < 0.05 as significant
        from ({_union([_chi_sql(f, 'tested') for f in _BINARY])}) join ({_union([
            f'''select '{f}' as f, avg(case when {f} = 0 then churn_label::double end) * 100 as pct_0,
                avg(case when {f} = 1 then churn_label::double end) * 100 as pct_1 from tested'''
            for f in _BINARY])}) on f = feature
        union all
        select {_NAME}, feature, 'Mann-Whitney', round({chi2_tail('z * z', '1')}, 6), round(effect_size_r, 4), null, null,
          null, round(mean_0, 3), round(mean_1, 3), {chi2_tail('z * z', '1')} < 0.05
        from ({_union([_mw_sql(f, 'tested') for f in _RANKED])})""",
    ["tested"],
    ["p_value", "effect_size", "churn_if_0", "churn_if_1", "lift", "mean_retained", "mean_churned"],
)
def hypothesis_table(t: Tables) -> DataFrame:
    """All nine published hypotheses."""
    return hypothesis_summary(hypothesis_features(t.bills, t.cc, t.rc, t.emails))


@query(
    "S11",
    "select feature, round(cramers_v, 4) as cramers_v from "
    f"({_union([_chi_sql(f) for f in CHI_FEATURES[:2]])})",
    ["features"],
    ["cramers_v"],
)
def write_test_summary(t: Tables) -> DataFrame:
    import uuid

    from renewlens.session import shared_dir
    from renewlens.sources.tables import write_test_summary as write

    path = f"{shared_dir(t.spark)}/io-{uuid.uuid4().hex}"
    write(st.chi_square_tests(t.features, CHI_FEATURES[:2]), path)
    return t.spark.read.option("header", True).csv(path).select(
        "feature", F.round(F.col("cramers_v").cast("double"), 4).alias("cramers_v")
    )
