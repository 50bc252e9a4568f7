"""Cohort and behavioural features on a small hand-made set, including a customer that dominates."""

import datetime as dt

import pytest

from renewlens import schema as s
from renewlens.operators import behaviour as b
from renewlens.operators import cohort as c
from renewlens.operators.cleaning import clean_all
from renewlens.plans.features import build_cohort_features
from renewlens.sources import tables as src


@pytest.fixture(scope="module")
def data(spark):
    bills = spark.createDataFrame(
        [
            # key, year, renewal, closed, outcome, last paid, flag, anchors, band, last band, score, tenure
            ("A", "2024", "01/03/2024", "10/03/2024", " Won ", "100", "y", "0", "Band C1", "Band B", "10", "1"),
            ("B", "2024", "01/03/2024", "29/03/2024", "Churned", None, "Yes", "1", "Band A", "Band J", "20", "2.5"),
            ("C", "2024", "01/03/2024", "30/03/2024", "Won", "5", "n", "3", None, None, "30", "8"),
            ("D", "2024", "01/03/2024", "01/03/2024", "Won", "5", "n", "3", "Group", None, "30", "8"),
            ("E", "2024", "01/03/2024", "02/03/2024", "Open", "5", "n", "3", "Group", None, "30", "8"),
            ("F", "2024", "01/03/2024", "05/03/2024", "Won", "7", None, "4", "Band Z", "Band Z", None, "5"),
            ("A", "2025", "01/03/2025", "10/03/2025", "Churned", "120", "n", "0", "Band C1", "Band C1", "50", "2"),
        ],
        "Co_Ref string, Renewal_Year string, Prospect_Renewal_Date string, Closed_Date string, "
        "Prospect_Outcome string, Last_Total_Net_Paid string, Current_Auto_Renewal_Flag string, "
        "Current_Anchorings string, Band string, Last_Band string, "
        "Renewal_Score_At_Release string, Tenure_Years string",
    )
    cc = spark.createDataFrame(
        [("A", "2024", "Yes", "10", "5", " IN_BOUND ")] * 2
        + [("A", "2024", "No", "Not Discussed", "5", "OUT_BOUND")]
        + [("A", "2023", "Yes", "1", "2", "IN_BOUND"), (None, "2024", "Yes", "1", "2", "IN_BOUND")]
        + [("Z", "2024", "Yes", "1", "2", "IN_BOUND")] * 500,
        "Co_Ref string, Call_Year string, cc_contractor_suggest_leave string, "
        "cc_contractor_sentiment_start_score string, cc_contractor_sentiment_end_score string, "
        "Direction string",
    )
    rc = spark.createDataFrame(
        [
            ("B", "2024", "4", "OUT_BOUND", "Yes (please)", "[No]", "Yes"),
            ("B", "2024", "x", "outbound", "No", "yes", "Yes"),
        ],
        "Co_Ref string, Call_Year string, Call_Number string, Call_Direction string, "
        "Discount_or_Waiver_Requested string, Explicit_Switching_Intent string, "
        "Desire_To_Cancel string",
    )
    emails = spark.createDataFrame([("A", "2025", "prior_year")], "Co_Ref string, year string, Time_to_Renewal string")
    return clean_all({"billings": bills, "cc_calls": cc, "renewal_calls": rc, "emails": emails})


@pytest.fixture(scope="module")
def table(data):
    rows = build_cohort_features(data["billings"], data["cc_calls"], data["renewal_calls"]).collect()
    return {(r["Co_Ref"], r["Renewal_Year"]): r.asDict() for r in rows}


def test_window_and_outcomes(table):
    assert set(table) == {("A", 2024), ("B", 2024), ("F", 2024), ("A", 2025)}
    assert table["B", 2024]["churn_label"] == 1 and table["A", 2024]["churn_label"] == 0


def test_billing_flags(table):
    a, b_, f = table["A", 2024], table["B", 2024], table["F", 2024]
    assert (a["is_first_year"], b_["is_first_year"]) == (0, 1)
    assert b_["Last_Total_Net_Paid"] == 0.0
    # the exact-case map does not know "Yes", so B counts as off like a missing flag
    assert (a["auto_renewal_off"], b_["auto_renewal_off"], f["auto_renewal_off"]) == (0, 1, 1)
    assert (a["anchoring_zero"], b_["anchoring_1plus"], f["anchoring_3plus"]) == (1, 1, 1)
    assert (a["band_enc"], a["band_upgraded"], a["band_downgraded"]) == (3, 1, 0)
    assert (b_["band_enc"], b_["band_downgraded"]) == (1, 1)
    assert (f["band_enc"], f["band_upgraded"], f["band_downgraded"]) == (0, 0, 0)
    # 2.5 years falls between the tenure flags
    assert [b_[k] for k in ("tenure_0_1", "tenure_2_3", "tenure_4_7", "tenure_8plus")] == [0, 1, 0, 0]
    assert a["tenure_0_1"] == 1 and f["tenure_4_7"] == 1


def test_release_quartile_is_per_year(table):
    # 2024 scores are 10 and 20: quartile 12.5; 2025 has one score, below which nothing lies
    assert table["A", 2024]["low_release_score"] == 1
    assert table["B", 2024]["low_release_score"] == 0
    assert table["F", 2024]["low_release_score"] == 0
    assert table["A", 2025]["low_release_score"] == 0


def test_call_features(table):
    a = table["A", 2024]
    assert (a["cc_call_count"], a["cc_ever_suggest_leave"], a["cc_multiple_calls"]) == (3, 1, 1)
    assert (a["cc_avg_sentiment_delta"], a["cc_sentiment_worsened"]) == (-5.0, 1)
    assert a["cc_inbound_ratio"] == pytest.approx(2 / 3)
    b_ = table["B", 2024]
    assert (b_["rc_call_count"], b_["rc_max_call_number"], b_["rc_high_friction"]) == (2, 4.0, 1)
    assert (b_["rc_discount_requested"], b_["rc_switching_intent"], b_["rc_agent_chased"]) == (1, 1, 1)
    assert table["F", 2024]["cc_call_count"] == 0 and table["A", 2025]["cc_call_count"] == 0


def test_composites(table):
    a, b_, f = table["A", 2024], table["B", 2024], table["F", 2024]
    assert (a["any_leave_signal"], b_["any_leave_signal"], f["any_leave_signal"]) == (1, 1, 0)
    assert a["total_negative_flags"] == 2
    assert b_["total_negative_flags"] == 3
    assert (f["has_no_behavioural_data"], f["total_contact_count"]) == (1, 0)
    assert b_["high_friction_score"] == 2
    assert table["A", 2025]["critical_risk_billing"] == 1


def test_leakage_never_reaches_the_table(table, data):
    assert not set(s.LEAKAGE) & set(next(iter(table.values())))
    assert not set(s.LEAKAGE) & set(c.drop_leakage(data["renewal_calls"]).columns)


def test_model_features_are_numeric_and_complete(data):
    df = build_cohort_features(data["billings"], data["cc_calls"], data["renewal_calls"])
    names = c.model_feature_names(df)
    assert len(names) == 9 + 13 + 15 + 14 + 9
    assert "churn_label" not in names and "Co_Ref" not in names and "#_of_Connection" in names


def test_one_year_equals_the_all_years_table(data, table):
    one = build_cohort_features(data["billings"], data["cc_calls"], data["renewal_calls"], 2024)
    assert {(r["Co_Ref"], r["Renewal_Year"]): r.asDict() for r in one.collect()} == {
        k: v for k, v in table.items() if k[1] == 2024
    }


def test_empty_cohort_raises(data):
    with pytest.raises(Exception, match="no rows in the post-renewal window"):
        c.build_billing_features(data["billings"], 1990).count()
    assert c.build_billing_features(data["billings"], 1990, check=False).count() == 0


def test_the_checked_build_scans_its_source_once(spark, tmp_path, data):
    """The rows are counted by the job that stages them; quartiles and result read what it wrote."""
    data["billings"].write.parquet(str(tmp_path / "b"))
    source = spark.read.parquet(str(tmp_path / "b"))
    built = c.build_billing_features(source)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "b") not in plan and "stage-" in plan
    lazy = c.build_billing_features(source, check=False, q25=1.0)
    assert lazy._jdf.queryExecution().executedPlan().toString().count(f"{tmp_path}/b") == 1
    assert built.drop("low_release_score").exceptAll(lazy.drop("low_release_score")).count() == 0


def test_joins_of_stored_tables_need_no_shuffle(spark, tmp_path, data):
    cc, rc = b.build_cc_features(data["cc_calls"]), b.build_rc_features(data["renewal_calls"])
    parts = {"base": c.cohort_rows(data["billings"]).select(*c.KEY), "cc": cc, "rc": rc}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = {n: src.write_keyed(df, f"keyed_{n}", str(tmp_path / n), 4) for n, df in parts.items()}
        join = lambda p: c.left_enrich(c.left_enrich(p["base"], p["cc"], c.KEY), p["rc"], c.KEY)
        plan = join(stored)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "Exchange" in join(parts)._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, join(stored).collect())) == sorted(map(str, join(parts).collect()))
        grouped = stored["cc"].groupBy(*c.KEY).count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in grouped
        again = src.write_keyed(parts["rc"].limit(0), "keyed_rc", str(tmp_path / "rc2"), 4)
        assert again.count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for n in parts:
            spark.sql(f"drop table if exists keyed_{n}")


def shuffled_rows(df):
    """Records that all shuffles of a query write, from the metrics of its static plan."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    total, queue = 0, [plan]
    while queue:
        node = queue.pop()
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        queue += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_other_calls_are_dropped_before_the_shuffle(spark, tmp_path):
    """A large call table against a small cohort, with the runtime filter and without."""
    spark.range(20_000).selectExpr("cast(id % 5000 as string) as Co_Ref", "id as n").write.parquet(str(tmp_path / "calls"))
    spark.range(5_000).selectExpr("cast(id as string) as Co_Ref", "cast(id % 50 as int) as Renewal_Year").write.parquet(
        str(tmp_path / "bills")
    )
    calls = spark.read.parquet(str(tmp_path / "calls"))
    base = spark.read.parquet(str(tmp_path / "bills")).where("Renewal_Year = 7")
    size = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    rows, plans, found, before = {}, {}, {}, spark.conf.get(size)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for limit in ("0", "10g"):
            spark.conf.set(size, limit)
            kept = c.restrict_to_cohort(calls, base)
            plans[limit] = kept._jdf.queryExecution().executedPlan().toString()
            rows[limit] = shuffled_rows(kept)
            found[limit] = sorted(r["n"] for r in kept.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set(size, before)
    assert "might_contain" in plans["0"] and "might_contain" not in plans["10g"]
    assert found["0"] == found["10g"] and len(found["0"]) == 400
    assert rows["10g"] >= 20_000 and rows["0"] < 4_000


def test_repeated_key_raises(data):
    twice = data["billings"].unionAll(data["billings"])
    with pytest.raises(Exception, match="repeated key"):
        c.build_billing_features(twice).collect()


def test_uniqueness_report(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "Co_Ref string, Renewal_Year int")
    row = c.check_unique_and_count(df, c.KEY).first()
    assert (row["n_rows"], row["n_keys"], row["n_duplicated"], row["ok"]) == (3, 2, 1, False)


def test_calls_are_reduced_before_the_shuffle(data):
    plan = b.build_cc_features(data["cc_calls"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange") > plan.index("count(")


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "renewal_calls.csv"
    path.write_text(
        'Co_Ref,Call_Year,Call_Date,Mentioned_Competitors\n'
        '"x1","2024","05/02/2024","said ""no"",\nthen left"\n'
        'NA,None,N/A,\n'
    )
    assert src.broken_quotes(spark, str(path)).first() == (4, 2)
    rows = src.read_renewal_calls(spark, str(path), multi_line=True).collect()
    assert rows[0]["Mentioned_Competitors"] == 'said "no",\nthen left'
    assert [rows[1][k] for k in ("Co_Ref", "Call_Year", "Call_Date", "Mentioned_Competitors")] == [None] * 4
    assert set(s.RC_COLUMNS) <= set(rows[0].asDict())
    clean = clean_all({"renewal_calls": src.read_renewal_calls(spark, str(path), multi_line=True)})["renewal_calls"]
    assert clean.first()["Call_Date"] == dt.datetime(2024, 2, 5)


def test_features_round_trip(spark, data, tmp_path):
    df = c.build_labels(data["billings"])
    src.write_features(df, str(tmp_path / "f"))
    back = src.read_features(spark, str(tmp_path / "f"))
    assert back.where("Renewal_Year = 2025").select("Co_Ref").first()[0] == "A"
    plan = back.where("Renewal_Year = 2025")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Renewal_Year" in plan


def test_feature_list_round_trip(spark, tmp_path):
    src.write_feature_list(spark, ["a", "#_of_Connection"], str(tmp_path / "l"))
    assert src.read_feature_list(spark, str(tmp_path / "l")) == ["a", "#_of_Connection"]


def test_predictions_are_sorted_and_rounded(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", 0.123456), ("b", 0.9), ("c", 0.5)], "Co_Ref string, churn_probability double"
    )
    src.write_predictions(df, str(tmp_path / "p"))
    lines = [
        line
        for part in sorted((tmp_path / "p").glob("part-*.csv"))
        for line in part.read_text().splitlines()
        if not line.startswith("Co_Ref")
    ]
    assert lines == ["b,0.9", "c,0.5", "a,0.1235"]


def test_align_columns(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    assert c.align_columns(df, ["b", "z"]).first().asDict() == {"a": 1, "b": 0, "z": 0}


def test_email_features_use_one_window(data):
    row = b.build_email_features(data["emails"]).first()
    assert row["email_count"] == 1 and len(row) == 15
    assert b.build_email_features(data["emails"], "14_out").count() == 0


def test_cohort_scan_is_pushed_down(spark, tmp_path, data):
    path = str(tmp_path / "bills")
    data["billings"].write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = (
        c.cohort_rows(spark.read.parquet(path), 2024)
        .select("Co_Ref")
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "EqualTo(Renewal_Year,2024)" in plan
    schema = plan[plan.index("ReadSchema"):]
    assert "Band" not in schema and "Total_Net_Paid" not in schema


def test_hypothesis_report_has_the_published_form(spark, tmp_path):
    from renewlens.plans.hypotheses import hypothesis_summary

    df = spark.createDataFrame(
        [(0, 0, 0.5)] * 10 + [(1, 1, 1.5)] * 10, "anchoring_zero int, churn_label int, Tenure_Years double"
    )
    summary = hypothesis_summary(df)
    assert [r["hypothesis"] for r in summary.collect()] == ["H1", "H6"]
    src.write_test_summary(summary, str(tmp_path / "s"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "s")).collect()
    first = {r["Hypothesis"]: r.asDict() for r in rows}
    assert list(first["H1"]) == list(s.SUMMARY_HEADERS.values())
    assert (first["H1"]["Lift (1 vs 0)"], first["H1"]["Significant"]) == ("N/A", "✓")
    assert first["H6"]["Mean Churned"] == "1.5" and first["H6"]["Churn if 0"] is None
