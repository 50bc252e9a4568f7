"""Table-driven cases for the text repairs, every null branch included."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from renewlens.functions import buckets
from renewlens.functions import scalars as fn


def apply(spark, values, column, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_extract_yes_no(spark):
    cases = {
        "Yes": "Yes", " no ": "No", "[No]": "No", "**no**": "No",
        "Yes (the customer asked if the price could be dropped)": "Yes",
        "None of these": "No", "Not sure": "No", "Now it is late": "No", "Yesterday": "Yes",
        "Not applicable": None, "NOT DISCUSSED": None, "XXXX": None, "UNAVAILABLE": None, "": None,
        "  ": None, "well, yes indeed": "Yes", "Customer said no": "No", "both no and yes": "Yes",
        "a remark that is much too long to read yes": None, "eyes and nose": None, None: None,
    }
    assert apply(spark, list(cases), fn.extract_yes_no("v")) == list(cases.values())


def test_clean_yes_no(spark):
    cases = {
        "Yes": "Yes", " y": "Yes", "TRUE": "Yes", "1": "Yes", "No": "No", "n ": "No", "False": "No",
        "0": "No", "Not Discussed": "No", "not applicable": "No", "maybe": None, "": None,
        "The caller explained at length": None, None: None,
    }
    values = list(cases)
    assert apply(spark, values, fn.clean_yes_no("v")) == list(cases.values())
    strict = apply(spark, values, fn.clean_yes_no("v", not_discussed_as_null=True))
    assert strict[values.index("Not Discussed")] is None
    assert strict[values.index("0")] == "No"


def test_auto_renewal_map_is_case_exact(spark):
    values = ["y", "Y", " yes ", "Yes", "YES", "n", "N", "no", "No", "x", None]
    assert apply(spark, values, fn.map_auto_renewal("v")) == [
        "Yes", "Yes", "Yes", None, None, "No", "No", "No", None, None, None,
    ]
    assert apply(spark, values, fn.map_auto_renewal("v", strict=False))[3:9] == [
        "Yes", "Yes", "No", "No", "No", "No",
    ]


def test_to_number(spark):
    cases = {
        "12": 12.0, " -3.5 ": -3.5, "+.5": 0.5, "1e3": 1000.0, "7.": 7.0, "1d": None, "NaN": None,
        "1,000": None, "Not Discussed": None, "": None, "inf": None, None: None,
    }
    assert apply(spark, list(cases), fn.to_number("v")) == list(cases.values())
    assert apply(spark, ["2024", "x"], fn.to_nullable_int("v")) == [2024, None]
    assert apply(spark, ["4", "none", None], fn.coerce_count_fill0("v")) == [4.0, 0.0, 0.0]


def test_parse_dayfirst(spark):
    d = dt.datetime
    cases = {
        "29-01-2025": d(2025, 1, 29), "1/2/2024": d(2024, 2, 1), "31.12.2023 10:05": d(2023, 12, 31, 10, 5),
        "2024-03-04": d(2024, 3, 4), "2024-3-4 11:22:33": d(2024, 3, 4, 11, 22, 33),
        "2024-03-04T09:08": d(2024, 3, 4, 9, 8), "2024/5/6": d(2024, 5, 6), "5 Mar 2024": d(2024, 3, 5),
        "05-MAR-2024": d(2024, 3, 5), "45000": None, "13/13/2024": None, "2024": None, "": None,
        "soon": None, None: None,
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v string")
    got = [r["v"] for r in fn.parse_dayfirst(df, "v").orderBy("i").collect()]
    assert got == list(cases.values())


def test_lookups(spark):
    assert apply(spark, ["OUT_BOUND", " inbound", "transfer", None], fn.normalise_direction("v")) == [
        "Outbound", "Inbound", None, None,
    ]
    values = ["Satisfied", " positive ", "not discussed", "Initially dissatisfied, later satisfied", "Yes"]
    assert apply(spark, values, fn.map_email_sentiment("v")) == [
        "Positive", "Positive", "Neutral", "Positive", None,
    ]
    assert apply(spark, ["Satisfied", "satisfied", None], fn.whitelist_sentiment("v")) == [
        "Satisfied", None, None,
    ]
    assert apply(spark, ["Yes/No", "Yes", None], fn.values_to_null("v", ["Yes/No"])) == [
        None, "Yes", None,
    ]


@pytest.mark.parametrize("token", ["", "NA", "N/A", "NULL", "None", "nan", "<NA>", "#N/A"])
def test_null_tokens(spark, token):
    assert apply(spark, [token, "kept"], fn.null_token_to_null("v")) == [None, "kept"]


def test_blank_characters_are_stripped(spark):
    assert apply(spark, ["\t a b \n", "   "], fn.normalise_key("v")) == ["a b", None]


def test_buckets_are_right_closed(spark):
    got = apply(
        spark, [-1.0, 0.0, 1.0, 1.5, 3.0, 7.0, 100.0, 101.0, None],
        buckets.bucketize_right("v", *buckets.TENURE), "double",
    )
    assert got == [None, "0-1yr", "0-1yr", "2-3yr", "2-3yr", "4-7yr", "8+yr", None, None]
    got = apply(
        spark, [-0.01, 0.0, 0.01, 0.1, 0.11, None],
        buckets.bucketize_right("v", *buckets.PRICE_4), "double",
    )
    assert got == ["Decreased", "Flat", "Flat", "1-10% up", ">10% up", None]


def test_clip_and_ratio_keep_null(spark):
    assert apply(spark, [0.0, 9.0, None], fn.clip("v", 1.0, 5.0), "double") == [1.0, 5.0, None]
    assert apply(spark, [4.0, 0.0, None], fn.ratio_change(F.lit(6.0), "v"), "double") == [
        0.5, None, None,
    ]
    assert apply(spark, [1.0, math.inf, math.nan], fn.finite("v"), "double") == [1.0, None, None]
