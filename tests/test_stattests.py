"""Textbook points of the tail functions and small contingency tables."""

import math

import pytest
from pyspark.sql import functions as F

from renewlens.functions.pvalues import chi2_p_value, kolmogorov_p, normal_two_sided_p
from renewlens.operators import stattests as st


def expand(spark, cells):
    rows = [(f, y) for (f, y), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows, "f string, y int")


def test_chi_square_tail(spark):
    points = [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (23.209, 10, 0.01), (0.0, 1, 1.0)]
    df = spark.createDataFrame(points, "x double, d int, p double")
    for r in df.select("p", chi2_p_value("x", "d").alias("q")).collect():
        assert r["q"] == pytest.approx(r["p"], abs=1e-5)


def test_normal_tail(spark):
    df = spark.createDataFrame([(1.959964, 0.05), (2.575829, 0.01), (-1.0, 1.0)], "z double, p double")
    for r in df.select("p", normal_two_sided_p("z").alias("q")).collect():
        assert r["q"] == pytest.approx(r["p"], abs=1e-6)


def test_kolmogorov_tail(spark):
    # critical values of the limiting distribution
    df = spark.createDataFrame([(1.3581, 0.05), (1.6276, 0.01), (0.05, 1.0)], "x double, p double")
    for r in df.select("p", kolmogorov_p(F.col("x"), F.lit(1.0)).alias("q")).collect():
        assert r["q"] == pytest.approx(r["p"], abs=1e-4)


def test_two_by_two_uses_the_continuity_correction(spark):
    df = expand(spark, {("0", 0): 90, ("0", 1): 10, ("1", 0): 30, ("1", 1): 20})
    row = st.chi_square_test(df, "f", "y").first()
    n, a, b, c, d = 150, 90, 10, 30, 20
    want = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert row["chi2"] == pytest.approx(want)
    assert row["dof"] == 1
    assert row["p_value"] == pytest.approx(math.erfc(math.sqrt(want / 2)))
    assert row["cramers_v"] == pytest.approx(math.sqrt(want / n))


def test_larger_table_is_uncorrected(spark):
    cells = {("a", 0): 20, ("a", 1): 5, ("b", 0): 15, ("b", 1): 15, ("c", 0): 10, ("c", 1): 0}
    row = st.chi_square_test(expand(spark, cells), "f", "y").first()
    rows = {"a": 25, "b": 30, "c": 10}
    cols = {0: 45, 1: 20}
    want = sum(
        (n - rows[f] * cols[y] / 65) ** 2 / (rows[f] * cols[y] / 65) for (f, y), n in cells.items()
    )
    assert row["chi2"] == pytest.approx(want)
    assert row["dof"] == 2


def test_single_level_is_degenerate(spark):
    row = st.chi_square_test(expand(spark, {("1", 0): 5, ("1", 1): 3}), "f", "y").first()
    assert (row["chi2"], row["dof"], row["p_value"], row["cramers_v"]) == (0.0, 0, 1.0, None)


def test_effect_size_counts_rows_without_a_value(spark):
    df = expand(spark, {("0", 0): 90, ("0", 1): 10, ("1", 0): 30, ("1", 1): 20})
    more = df.unionByName(spark.createDataFrame([(None, 0)] * 50, "f string, y int"))
    a, b = (st.chi_square_test(d, "f", "y").first() for d in (df, more))
    assert a["chi2"] == pytest.approx(b["chi2"])
    assert b["n_rows"] == 200
    assert b["cramers_v"] == pytest.approx(math.sqrt(b["chi2"] / 200))


def test_drift_report_orders_by_distance(spark):
    a = spark.range(2000).selectExpr("id % 10 as same", "id % 10 as moved")
    b = spark.range(2000).selectExpr("id % 10 as same", "id % 10 + 3 as moved")
    rows = st.drift_report(a, b, ["same", "moved", "absent"]).collect()
    assert [r["feature"] for r in rows] == ["moved", "same"]
    assert rows[0]["ks_stat"] == pytest.approx(0.3) and rows[0]["shifted"]
    assert rows[1]["ks_stat"] == 0.0 and not rows[1]["shifted"]
