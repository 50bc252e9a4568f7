"""Profile operators on tiny tables with nulls, constants and one-sided groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from renewlens.operators import cohort as c
from renewlens.operators import profiling as p


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}


def test_column_inventory(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "`a.b` int, `#_c` string")
    got = rows(p.column_inventory(df.withColumnRenamed("a.b", "a")), "column")
    assert got["a"]["null_count"] == 1 and got["a"]["null_pct"] == 33.33 and got["a"]["dtype"] == "int"
    assert got["#_c"]["null_count"] == 2


def test_classify_columns(spark):
    df = spark.createDataFrame(
        [("k1", "Yes", "Yes", "text one", 1.0, None), ("k2", "No", "maybe", "text two", 2.0, None),
         ("k3", None, "No", "x" * 100, 3.0, None)],
        "Co_Ref string, f string, g string, t string, n double, e string",
    )
    got = {k: v["kind"] for k, v in rows(p.classify_columns(df), "column").items()}
    assert got == {"Co_Ref": "id", "f": "yes_no", "g": "yes_no", "t": "free_text", "n": "numeric", "e": "yes_no"}


def test_numeric_text(spark):
    df = spark.createDataFrame([("1", "x", 1), ("2.5", "3", 2), (None, None, 3)], "a string, b string, c int")
    assert [r[0] for r in p.numeric_stored_as_text(df).collect()] == ["a"]


def test_not_open_keeps_missing_outcomes(spark):
    df = spark.createDataFrame([("Open",), ("Won",), (None,), ("Churned",)], "Prospect_Outcome string")
    assert c.not_open(df).count() == 3
    assert c.decided_only(df).count() == 2


def test_correlation_paths_agree(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(300, 14)), columns=[f"c{i}" for i in range(14)])
    pdf["c1"] = pdf.c0 * 2 + 1e6
    pdf["c2"] = 5.0
    pdf.loc[::7, "c3"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.nanvl(f"c{i}", F.lit(None)).alias(f"c{i}") for i in range(14)])
    names = list(pdf.columns)
    wide = rows(p.correlation_matrix(df, names), "a", "b")
    assert len(wide) == 91
    few = rows(p.correlation_matrix(df, names[:5]), "a", "b")
    want = pdf.corr()
    for (a, b), r in {**wide, **few}.items():
        if "c2" in (a, b):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(want.loc[a, b], abs=1e-9)
    assert wide["c0", "c3"]["n"] == pdf.c3.notna().sum()


def test_churn_by_quantile_merges_equal_edges(spark):
    df = spark.createDataFrame([(0.0, 0)] * 80 + [(1.0, 1)] * 10 + [(2.0, 1)] * 10, "v double, y int")
    got = p.churn_by_quantile(df, "v", F.col("y"), 5).orderBy("bin").collect()
    # edges 0, 0, 0, 0, 0.2, 2 collapse to 0, 0.2, 2
    assert [(r["n"], r["churn_pct"]) for r in got] == [(80, 0.0), (20, 100.0)]


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    got = rows(p.histogram(df, "v", 5), "bin")
    assert [got[i]["n"] for i in range(5)] == [2, 2, 2, 2, 3]
    flat = p.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 10).collect()
    assert [(r["bin"], r["n"]) for r in flat] == [(5, 4)]


def test_box_stats(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    row = p.box_stats(df, "v", "g").first()
    assert (row["q1"], row["q3"], row["whisker_hi"], row["n_outliers"]) == (2.25, 4.75, 5.0, 1)


def test_flag_prevalence_bases(spark):
    df = spark.createDataFrame([("Yes",), ("No",), (None,), (" yes",)], "f string")
    strict = p.flag_prevalence(df, ["f"]).first()
    assert (strict["yes_count"], strict["non_null"]) == (1, 3)
    loose = p.flag_prevalence(df, ["f"], of_all_rows=True, loose=True).first()
    assert (loose["yes_count"], loose["yes_pct"]) == (2, 50.0)


def test_feature_lift_without_base(spark):
    df = spark.createDataFrame([(1, 1), (1, 0)], "f int, churn_label int")
    row = p.feature_lift(df, ["f"]).first()
    assert row["pct_0"] is None and row["pct_1"] == 50.0 and row["lift"] is None


def test_peak_and_low_ties(spark):
    df = spark.createDataFrame([(3,), (3,), (1,), (1,), (2,), (4,)], "m int")
    assert p.peak_and_low(df, "m").first().asDict() == {"peak": 1, "peak_n": 2, "low": 2, "low_n": 1}


def test_key_sets_with_a_dominant_key(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("Co_Ref"))
    few = spark.createDataFrame([("hot",), ("none",), (None,)], "Co_Ref string")
    row = p.key_overlap(many, few).first()
    assert (row["n_b"], row["n_both"], row["coverage_pct"]) == (2, 1, 50.0)
    flags = c.has_record_flags(few, {"hit": many}).collect()
    assert sorted((r["Co_Ref"] or "", r["hit"]) for r in flags) == [("", 0), ("hot", 1), ("none", 0)]


def test_any_number_of_bands(spark):
    df = spark.range(1500).select(
        F.format_string("B%04d", "id").alias("Band"), F.format_string("B%04d", F.col("id") + 1).alias("Last_Band")
    )
    got = c.band_enc_sorted(df).orderBy("Band").collect()
    assert [r["band_enc"] for r in got] == list(range(1500))
    # the band after the last one does not occur as a band
    assert sum(r["band_downgraded"] for r in got) == 1499


def test_correlation_of_hard_columns(spark):
    """NaN and null are missing, constants have no r, a large offset costs nothing, |r| <= 1."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=2000)
    pdf = pd.DataFrame({"x": x, "y": 1e9 + x, "c": 0.1, "n": np.where(np.arange(2000) % 10 == 0, np.nan, 2 * x)})
    df = spark.createDataFrame(pdf).repartition(6).withColumn("z", F.lit(None).cast("double"))
    for names in (["x", "y", "c", "n", "z"], ["x", "y"], ["x", "c"], ["x", "n"]):
        got = rows(p.correlation_matrix(df, names), "a", "b")
        for (a, b), r in got.items():
            assert (r["r"] is None) == bool({"c", "z"} & {a, b})
            assert r["r"] is None or (abs(r["r"]) <= 1 and abs(r["r"] - 1) < 1e-6)
            assert r["n"] == (0 if "z" in (a, b) else 1800 if "n" in (a, b) else 2000)


def test_histogram_equals_numpy(spark):
    # tenths sit on edges that are not exact in binary
    values = [i / 10 for i in range(11)] * 3 + [0.30000000000000004, 0.7000000000000001]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows(p.histogram(df, "v", 10), "bin")
    want, edges = np.histogram(values, bins=10)
    assert [got[i]["n"] for i in range(10)] == list(want)
    assert [got[i]["lo"] for i in range(10)] == pytest.approx(list(edges[:-1]))
