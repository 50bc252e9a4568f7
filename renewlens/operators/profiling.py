"""Profiles, counts and churn-rate tables.

Column-wise profiles are one wide aggregate followed by an unpivot of its single row, never one job
per column. Shares divide by a scalar subquery or by a window over already aggregated rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renewlens import schema as s
from renewlens.functions import buckets
from renewlens.functions import scalars as fn
from renewlens.functions.scalars import flag, quoted
from renewlens.operators.cohort import not_open
from renewlens.operators.ladder import quantiles, quantiles_of_ladder, score_ladder
from renewlens.session import stage

OUTCOME = "Prospect_Outcome"


def percent(cond: Column) -> Column:
    """Share of rows where the condition holds, in percent; unknown counts as no."""
    return F.avg(flag(cond)) * 100


def _unpivot_one_row(row: DataFrame, names: Sequence[str], *measures: str) -> DataFrame:
    """One row of ``<measure>_<i>`` columns -> one row per column name."""
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("column"),
            *[F.col(f"{m}_{i}").alias(m) for m in measures],
        )
        for i, name in enumerate(names)
    ])
    keep = [c for c in row.columns if not any(c.startswith(f"{m}_") for m in measures)]
    return row.select(*keep, F.inline(entries))


# --- inventories -----------------------------------------------------------------


def column_inventory(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Name, type, null count and null percentage of every column."""
    names = list(columns or df.columns)
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(quoted(c)).isNull()).alias(f"null_count_{i}") for i, c in enumerate(names)],
    )
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return _unpivot_one_row(row, names, "null_count").select(
        "column",
        fn.lookup(F.col("column"), {c: types[c] for c in names}).alias("dtype"),
        "null_count",
        F.round(F.try_divide(F.col("null_count") * 100.0, F.col("rows")), 2).alias("null_pct"),
    )


def null_ranking(
    df: DataFrame,
    min_pct: float = 0.0,
    high: float = 50.0,
    medium: float = 10.0,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Columns with more than ``min_pct`` percent nulls, worst first, with a severity."""
    pct = F.col("null_pct")
    return (
        column_inventory(df, columns)
        .where(pct > min_pct)
        .withColumn(
            "severity", F.when(pct > high, "high").when(pct >= medium, "medium").otherwise("low")
        )
        .orderBy(F.desc("null_pct"), "column")
    )


def null_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that still contain nulls."""
    return (
        column_inventory(df, columns)
        .where(F.col("null_count") > 0)
        .select("column", "null_count")
    )


def numeric_stored_as_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns in which every non-null value parses as a number."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    names = [c for c in (columns or text) if c in text]
    row = df.agg(*[
        F.coalesce(
            F.bool_and(
                F.when(F.col(quoted(c)).isNotNull(), fn.to_number(quoted(c)).isNotNull())
            ),
            F.lit(True),
        ).alias(f"numeric_{i}")
        for i, c in enumerate(names)
    ])
    return _unpivot_one_row(row, names, "numeric").where("numeric").select("column")


def classify_columns(
    df: DataFrame, id_columns: Sequence[str] = ("Co_Ref", "Time_to_Renewal")
) -> DataFrame:
    """id / numeric / yes-no flag / free text, from the schema and the distinct values.

    Distinct values are counted through (column, value) rows, so long text never gathers in a set;
    text that is too long to be a flag travels as its digest.
    """
    kinds, text = {}, []
    for f in df.schema.fields:
        if f.name in id_columns:
            kinds[f.name] = "id"
        elif isinstance(f.dataType, T.NumericType):
            kinds[f.name] = "numeric"
        else:
            text.append(f.name)
    spark = df.sparkSession
    fixed = spark.createDataFrame(list(kinds.items()) or [], "column string, kind string")
    if not text:
        return fixed
    def short(c: str) -> Column:
        v = F.col(quoted(c)).cast("string")
        return F.when(F.length(v) > 64, F.sha2(v, 256)).otherwise(v)

    long = df.select(*[short(c).alias(c) for c in text]).unpivot([], text, "column", "value")
    value = F.col("value")
    per_column = (
        long.groupBy("column", "value")
        .agg(F.lit(1).alias("_one"))
        .groupBy("column")
        .agg(
            F.count("value").alias("n"),
            F.coalesce(F.bool_and(value.isin("Yes", "No", "Not Discussed")), F.lit(True)).alias(
                "only_flag_values"
            ),
            F.coalesce(F.bool_or(value == "Yes"), F.lit(False)).alias("yes"),
            F.coalesce(F.bool_or(value == "No"), F.lit(False)).alias("no"),
        )
    )
    is_flag = F.col("only_flag_values") | ((F.col("n") <= 5) & F.col("yes") & F.col("no"))
    return fixed.unionByName(
        per_column.select("column", F.when(is_flag, "yes_no").otherwise("free_text").alias("kind"))
    )


# --- counts ------------------------------------------------------------------------


def value_counts(
    df: DataFrame, column: str, normalize: bool = False, dropna: bool = True
) -> DataFrame:
    """Rows per value; optionally the share of all counted rows and the row for null."""
    rows = df.where(F.col(quoted(column)).isNotNull()) if dropna else df
    counts = rows.groupBy(quoted(column)).agg(F.count("*").alias("n"))
    if normalize:
        total = rows.agg(F.count("*").alias("t")).scalar()
        counts = counts.withColumn("share", F.try_divide(F.col("n").cast("double"), total))
    return counts


def value_counts_ordered(df: DataFrame, column: str, domain: Sequence) -> DataFrame:
    """Counts over a fixed domain in its order; absent values count 0."""
    c = F.col(quoted(column))
    row = df.agg(*[F.count_if(c == v).alias(f"n_{i}") for i, v in enumerate(domain)])
    entries = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(v).alias(column), F.col(f"n_{i}").alias("n"))
        for i, v in enumerate(domain)
    ])
    return row.select(F.inline(entries))


def top_k_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return value_counts(df, column).orderBy(F.desc("n"), quoted(column)).limit(k)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Contingency counts, one column per listed value; rows without either key are left out."""
    kept = df.where(F.col(row).isNotNull() & F.col(column).isin(list(values)))
    return kept.groupBy(row).agg(*[
        F.count_if(F.col(column) == v).alias(str(v)) for v in values
    ])


def crosstab_row_pct(
    df: DataFrame, row: str, column: str, values: Sequence, order: Sequence | None = None
) -> DataFrame:
    """Row-normalised percentages; ``order`` fixes which rows appear, and where."""
    counts = crosstab(df, row, column, values)
    total = sum((F.col(quoted(str(v))) for v in values[1:]), F.col(quoted(str(values[0]))))
    pct = counts.select(row, *[
        (F.try_divide(F.col(quoted(str(v))).cast("double"), total) * 100).alias(str(v))
        for v in values
    ])
    if order is None:
        return pct
    domain = df.sparkSession.createDataFrame(
        [(i, v) for i, v in enumerate(order)], f"position int, {row} string"
    )
    return domain.join(pct, row, "left")


def count_by_two(df: DataFrame, a: str, b: str) -> DataFrame:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.where(both).groupBy(a, b).agg(F.count("*").alias("n"))


def distinct_by_group(
    df: DataFrame, group: str, key: str = "Co_Ref", approx: bool = False
) -> DataFrame:
    """Rows and distinct keys per group."""
    distinct = F.approx_count_distinct(key) if approx else F.count_distinct(key)
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n_rows"), distinct.alias("n_keys")
    )


def events_per_customer(
    df: DataFrame, key: str = "Co_Ref", by: Sequence[str] = ()
) -> DataFrame:
    rows = df.where(F.col(key).isNotNull())
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    return rows.groupBy(*by, key).agg(F.count("*").alias("n"))


def tail_buckets(
    counts: DataFrame, ks: Sequence[int] = (5, 10, 15, 20), column: str = "n"
) -> DataFrame:
    """Customers with exactly one event and with at least k events."""
    n = F.col(column)
    return counts.agg(
        F.count("*").alias("customers"),
        F.count_if(n == 1).alias("n_1"),
        *[F.count_if(n >= k).alias(f"n_{k}_plus") for k in ks],
    )


def key_overlap(a: DataFrame, b: DataFrame, key: str = "Co_Ref") -> DataFrame:
    """Distinct keys on either side and in both, and the share of b that a covers."""
    left = a.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_a", F.lit(1))
    right = b.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_b", F.lit(1))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    n_a, n_b, n_both = F.count("_a"), F.count("_b"), F.count_if(both)
    return left.join(right, key, "full_outer").agg(
        n_a.alias("n_a"),
        n_b.alias("n_b"),
        n_both.alias("n_both"),
        (F.try_divide(n_both.cast("double"), n_b) * 100).alias("coverage_pct"),
    )


def coverage_counts(flags: DataFrame, a: str = "has_cc", b: str = "has_rc") -> DataFrame:
    """Rows with a record in a, in b, in both, in neither; counts and percentages."""
    in_a, in_b = F.col(a) == 1, F.col(b) == 1
    parts = {"a": in_a, "b": in_b, "both": in_a & in_b, "none": ~in_a & ~in_b}
    return flags.agg(
        F.count("*").alias("n"),
        *[F.count_if(c).alias(f"n_{name}") for name, c in parts.items()],
        *[percent(c).alias(f"pct_{name}") for name, c in parts.items()],
    )


# --- churn rates ---------------------------------------------------------------------


def churn_rate_by(
    df: DataFrame,
    group: str | Sequence[str],
    churned: Column | None = None,
    decided: bool = True,
) -> DataFrame:
    """Churn percentage and row count per group.

    With the default outcome column, Open rows are left out first; pass a 0/1 label as ``churned``
    with ``decided=False`` for tables that are already a cohort.
    """
    groups = [group] if isinstance(group, str) else list(group)
    rows = not_open(df) if decided else df
    for g in groups:
        rows = rows.where(F.col(g).isNotNull())
    churned = F.col(OUTCOME) == s.CHURNED if churned is None else churned == 1
    return rows.groupBy(*groups).agg(
        F.count("*").alias("n"), percent(churned).alias("churn_pct")
    )


def churn_by_bucket(df: DataFrame, bucket: Column, label: Column, name: str = "bucket") -> DataFrame:
    """Churn rate per labelled bin; empty bins do not appear."""
    return churn_rate_by(df.withColumn(name, bucket), name, label, decided=False)


def outcome_rates_by_year(df: DataFrame, year: str = "Renewal_Year") -> DataFrame:
    """Churn percentage among decided rows and open percentage among all, per year."""
    is_open = F.col(OUTCOME) == s.OPEN
    decided = F.count_if(~F.col(OUTCOME).eqNullSafe(F.lit(s.OPEN)))
    churned = F.count_if(F.col(OUTCOME) == s.CHURNED)
    return df.where(F.col(year).isNotNull()).groupBy(year).agg(
        F.count("*").alias("n"),
        decided.alias("n_decided"),
        (F.try_divide(churned.cast("double"), decided) * 100).alias("churn_pct"),
        percent(is_open).alias("open_pct"),
    )


def churn_by_quantile(
    df: DataFrame, column: str, label: Column, q: int = 5
) -> DataFrame:
    """Churn rate over equal-frequency bins; equal edges are merged, the lowest edge is inclusive."""
    names = {f"q{i}": i / q for i in range(q + 1)}
    cuts = quantiles(df, column, names)
    edges = cuts.select(F.array_distinct(F.array(*names))).scalar()
    v = F.col(quoted(column)).cast("double")
    rows = df.where(v.isNotNull()).withColumn("_edges", edges)
    position = F.greatest(F.size(F.filter("_edges", lambda e: e < v)), F.lit(1))
    return (
        rows.select("_edges", position.alias("bin"), flag(label == 1).alias("_y"))
        .groupBy("bin")
        .agg(
            F.min(F.element_at("_edges", F.col("bin"))).alias("lo"),
            F.min(F.try_element_at("_edges", F.col("bin") + 1)).alias("hi"),
            F.count("*").alias("n"),
            (F.avg("_y") * 100).alias("churn_pct"),
        )
    )


def churn_by_capped_count(
    df: DataFrame, column: str, label: Column, cap: float = 5
) -> DataFrame:
    capped = fn.clip(F.col(quoted(column)), upper=cap)
    return churn_rate_by(df.withColumn("capped", capped), "capped", label, decided=False)


def dose_response(df: DataFrame, column: str, label: Column, min_n: int = 20) -> DataFrame:
    """Churn rate per value of a count, for values with at least ``min_n`` rows."""
    return churn_rate_by(df, column, label, decided=False).where(F.col("n") >= min_n)


def rate_by_coverage(
    df: DataFrame, flags: Sequence[str], label: str = "churn_label"
) -> DataFrame:
    """Rows and churn rate with and without a record, per source."""
    long = df.select(label, *flags).unpivot([label], list(flags), "source", "has_record")
    return long.groupBy("source", "has_record").agg(
        F.count("*").alias("n"), percent(F.col(label) == 1).alias("churn_pct")
    )


def rate_by_onehot(df: DataFrame, flags: Sequence[str], label: str = "churn_label") -> DataFrame:
    """Churn rate among the rows where each indicator is 1."""
    row = df.agg(*[
        c
        for i, f in enumerate(flags)
        for c in (
            F.count_if(F.col(f) == 1).alias(f"n_{i}"),
            (F.avg(F.when(F.col(f) == 1, F.col(label).cast("double"))) * 100).alias(
                f"churn_pct_{i}"
            ),
        )
    ])
    return _unpivot_one_row(row, flags, "n", "churn_pct")


def feature_lift(df: DataFrame, flags: Sequence[str], label: str = "churn_label") -> DataFrame:
    """Churn rate at 0 and at 1, and their ratio, best lift first."""
    row = df.agg(*[
        (F.avg(F.when(F.col(f) == v, F.col(label).cast("double"))) * 100).alias(f"pct_{v}_{i}")
        for i, f in enumerate(flags)
        for v in (0, 1)
    ])
    return (
        _unpivot_one_row(row, flags, "pct_0", "pct_1")
        .withColumn("lift", F.try_divide("pct_1", "pct_0"))
        .orderBy(F.desc_nulls_last("lift"), "column")
    )


# --- distributions -------------------------------------------------------------------


def describe(
    df: DataFrame, columns: Sequence[str], by: str | None = None, approx: bool = False
) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per column, overall or per group.

    NaN counts as missing everywhere. A column without values, overall or in a group, has count 0.
    """
    by_cols = [by] if by else []
    values = [
        F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns
    ]
    long = df.select(*by_cols, *values).unpivot(by_cols, list(columns), "column", "value")
    keys = [*by_cols, "column"]
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    cuts = quantiles(long, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, keys, approx)
    return moments.join(cuts.drop("n"), keys, "left").select(
        *keys, "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def histogram(
    df: DataFrame, column: str, bins: int, by: str | None = None
) -> DataFrame:
    """Equal-width counts between the column's extremes; the last bin is closed on the right.

    A constant column gets a range of one around its value.
    """
    v = F.col(quoted(column)).cast("double")
    rows = df.where(v.isNotNull())
    if by:
        rows = rows.where(F.col(by).isNotNull())
    ends = rows.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    keys = [by, "bin"] if by else ["bin"]
    return in_equal_bins(rows.withColumn("_ends", ends), v, bins).groupBy(*keys).agg(
        F.min(F.col("_lo") + F.col("bin") * F.col("_step")).alias("lo"),
        F.count("*").alias("n"),
    )


def in_equal_bins(rows: DataFrame, v: Column, bins: int) -> DataFrame:
    """Adds ``_lo``, ``_step`` and ``bin`` from the range in the struct column ``_ends`` (lo, hi)."""
    lo, hi = F.col("_ends.lo"), F.col("_ends.hi")
    flat = F.when(lo == hi, 0.5).otherwise(0.0)
    return rows.withColumns(
        {"_lo": lo - flat, "_step": (hi - lo + 2 * flat) / bins}
    ).withColumn("bin", buckets.equal_width_bin(v, F.col("_lo"), F.col("_step"), bins))


def box_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles, whisker ends within 1.5 quartile ranges, and the number of points beyond."""
    ladder = score_ladder(df, column, {"all": F.lit(1)}, [by])
    quart = quantiles_of_ladder(ladder, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return ladder.join(quart, by).groupBy(by).agg(
        F.first("n").alias("n"),
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.coalesce(F.sum(F.when(~inside, F.col("n_all"))), F.lit(0)).alias("n_outliers"),
    )


# --- flags ---------------------------------------------------------------------------


def flag_prevalence(
    df: DataFrame, flags: Sequence[str], of_all_rows: bool = False, loose: bool = False
) -> DataFrame:
    """Yes count, non-null count and Yes percentage (of non-null or of all rows) per flag."""
    def yes(c: str) -> Column:
        return fn.is_yes_loose(c) if loose else flag(F.col(c) == "Yes")

    row = df.agg(
        F.count("*").alias("rows"),
        *[F.coalesce(F.sum(yes(c)), F.lit(0)).alias(f"yes_count_{i}") for i, c in enumerate(flags)],
        *[F.count(c).alias(f"non_null_{i}") for i, c in enumerate(flags)],
    )
    base = F.col("rows") if of_all_rows else F.greatest(F.col("non_null"), F.lit(1))
    return _unpivot_one_row(row, flags, "yes_count", "non_null").select(
        "column",
        "yes_count",
        "non_null",
        (F.try_divide(F.col("yes_count").cast("double"), base) * 100).alias("yes_pct"),
    )


def flag_by_window(
    df: DataFrame, flags: Sequence[str], window: str = "Time_to_Renewal"
) -> DataFrame:
    """Yes count and populated percentage of each flag in each window, long form."""
    per = df.where(F.col(window).isNotNull()).groupBy(window).agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c) == "Yes").alias(f"yes_count_{i}") for i, c in enumerate(flags)],
        *[F.count(c).alias(f"non_null_{i}") for i, c in enumerate(flags)],
    )
    return _unpivot_one_row(per, flags, "yes_count", "non_null").select(
        window,
        "column",
        "yes_count",
        (F.col("non_null") * 100.0 / F.col("rows")).alias("populated_pct"),
    )


def flag_by_window_wide(
    df: DataFrame,
    flags: Sequence[str],
    window: str = "Time_to_Renewal",
    windows: Sequence[str] = tuple(s.EMAIL_WINDOWS),
) -> DataFrame:
    """Flags as rows, windows as columns, Yes counts as values."""
    long = flag_by_window(df, flags, window)
    return long.groupBy("column").agg(*[
        F.coalesce(F.sum(F.when(F.col(window) == w, F.col("yes_count"))), F.lit(0)).alias(w)
        for w in windows
    ])


def conditional_rate(df: DataFrame, given: Column, target: Column) -> DataFrame:
    """P(target | given), P(target | not given) and the uplift, in percent."""
    hit = flag(target).cast("double") * 100
    known = flag(given)
    return df.select(hit.alias("_t"), known.alias("_g")).agg(
        F.count_if(F.col("_g") == 1).alias("n_given"),
        F.avg(F.when(F.col("_g") == 1, F.col("_t"))).alias("p_given"),
        F.avg(F.when(F.col("_g") == 0, F.col("_t"))).alias("p_not_given"),
    ).withColumn("uplift", F.col("p_given") - F.col("p_not_given"))


def risk_by_direction(df: DataFrame) -> DataFrame:
    """Complaint, dissatisfaction, leave and worsened-sentiment rates per call direction, percent."""
    rows = df.withColumn("direction", fn.strip_upper("Direction")).where(
        F.col("direction").isin("IN_BOUND", "OUT_BOUND")
    )
    worse = fn.to_number("cast(cc_contractor_sentiment_end_score as string)") < fn.to_number(
        "cast(cc_contractor_sentiment_start_score as string)"
    )
    return rows.groupBy("direction").agg(
        F.count("*").alias("call_count"),
        (F.avg(fn.is_yes_loose("cc_contractor_complained")) * 100).alias("complaint_rate"),
        (F.avg(fn.is_yes_loose("cc_dissatisfaction_support")) * 100).alias("dissatisfaction_rate"),
        (F.avg(fn.is_yes_loose("cc_contractor_suggest_leave")) * 100).alias("suggest_leave_rate"),
        percent(worse).alias("worsened_sentiment_rate"),
    )


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Wide to long: one row per id and measure."""
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return cast.unpivot(list(ids), list(values), "metric", "value")


def delta_by_flag(df: DataFrame, flags: Sequence[str], delta: str = "sentiment_delta") -> DataFrame:
    """Mean delta and calls for YES and NO of each flag, over calls that have a delta."""
    long = (
        df.where(F.col(delta).isNotNull())
        .select(delta, *[fn.strip_upper(f"cast({quoted(c)} as string)").alias(c) for c in flags])
        .unpivot([delta], list(flags), "column", "flag_value")
        .where(F.col("flag_value").isin("YES", "NO"))
    )
    return long.groupBy("column", "flag_value").agg(
        F.avg(delta).alias("avg_delta"), F.count("*").alias("calls")
    )


def ends_worse(delta_table: DataFrame) -> DataFrame:
    return delta_table.where(F.col("avg_delta") < 0)


def pivot_yes_no(delta_table: DataFrame) -> DataFrame:
    """Mean delta and calls as YES and NO columns per flag, worst YES first."""
    def pick(value: str, measure: str) -> Column:
        return F.max(F.when(F.col("flag_value") == value, F.col(measure)))

    return delta_table.groupBy("column").agg(
        pick("YES", "avg_delta").alias("avg_delta_yes"),
        pick("NO", "avg_delta").alias("avg_delta_no"),
        pick("YES", "calls").alias("calls_yes"),
        pick("NO", "calls").alias("calls_no"),
    ).orderBy(F.asc_nulls_last("avg_delta_yes"), "column")


def delta_shares(df: DataFrame, delta: str = "sentiment_delta", by: str | None = None) -> DataFrame:
    """Scored rows and the percentages that improved, worsened and stayed flat."""
    rows = df.where(F.col(delta).isNotNull())
    d = F.col(delta)
    return rows.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("scored"),
        percent(d > 0).alias("improved_pct"),
        percent(d < 0).alias("worse_pct"),
        percent(d == 0).alias("flat_pct"),
        F.avg(d).alias("avg_delta"),
    )


def mean_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n")
    )


def monthly_rate(df: DataFrame, month: Column, decision: str) -> DataFrame:
    """Rows per month and the share of each decision within its month."""
    counts = (
        df.withColumn("month", month)
        .where(F.col("month").isNotNull() & F.col(decision).isNotNull())
        .groupBy("month", decision)
        .agg(F.count("*").alias("n"))
    )
    # aggregated rows only: months times decisions
    total = F.sum("n").over(Window.partitionBy("month"))
    return counts.withColumns({"month_n": total, "share": F.col("n") / total})


def peak_and_low(df: DataFrame, group: str) -> DataFrame:
    """Values with the most and the fewest rows; ties go to the smaller value."""
    counts = value_counts(df, group)
    by_size = F.struct(F.col("n"), F.col(quoted(group)))
    counts = counts.withColumn("_low", by_size)
    # ordering by (-n, value) makes the smaller value win among equal peaks
    counts = counts.withColumn("_peak", F.struct((-F.col("n")).alias("m"), F.col(quoted(group)).alias("v")))
    return counts.agg(F.min("_peak").alias("p"), F.min("_low").alias("l")).select(
        F.col("p.v").alias("peak"),
        (-F.col("p.m")).alias("peak_n"),
        F.col(f"l.{quoted(group)}").alias("low"),
        F.col("l.n").alias("low_n"),
    )


def share_over(df: DataFrame, conditions: Mapping[str, Column], base: Column | None = None) -> DataFrame:
    """Percentage of rows per named condition, over all rows or over those with ``base``."""
    rows = df if base is None else df.where(base)
    return rows.agg(
        F.count("*").alias("n"), *[percent(c).alias(name) for name, c in conditions.items()]
    )


def unparsed_dates(df: DataFrame, parsed: str) -> DataFrame:
    """Rows whose date column is null after parsing."""
    return df.agg(F.count_if(F.col(parsed).isNull()).alias("unparsed"), F.count("*").alias("n"))


# --- correlation ---------------------------------------------------------------------

_MOMENTS = ("n", "ma", "mb", "caa", "cbb", "cab")


def _task_moments(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Counts, means and centred products of each pair's complete rows, one row per pair and task.

    Batches are centred on their own means before products are added and merged by the usual update
    for centred sums, so a large offset costs no precision. NaN counts as missing.
    """
    index = {c: i for i, c in enumerate(columns)}
    ia = np.array([index[a] for a, _ in pairs])
    ib = np.array([index[b] for _, b in pairs])
    x = df.select(*[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def of_batch(v: np.ndarray) -> list[np.ndarray]:
        known = ~np.isnan(v)
        count = known.sum(axis=0)
        shift = np.where(known, v, 0.0).sum(axis=0) / np.maximum(count, 1)
        z = np.where(known, v - shift, 0.0)
        m = known.astype(float)
        n, sa, sb = (m.T @ m)[ia, ib], (z.T @ m)[ia, ib], (m.T @ z)[ia, ib]
        saa, sbb, sab = ((z * z).T @ m)[ia, ib], (m.T @ (z * z))[ia, ib], (z.T @ z)[ia, ib]
        safe = np.maximum(n, 1)
        return [
            n, shift[ia] + sa / safe, shift[ib] + sb / safe,
            np.maximum(saa - sa * sa / safe, 0.0), np.maximum(sbb - sb * sb / safe, 0.0), sab - sa * sb / safe,
        ]

    def merge(p: list[np.ndarray], q: list[np.ndarray]) -> list[np.ndarray]:
        n = p[0] + q[0]
        safe = np.maximum(n, 1)
        da, db = np.where(p[0] > 0, q[1] - p[1], 0.0), np.where(p[0] > 0, q[2] - p[2], 0.0)
        da, db = np.where(q[0] > 0, da, 0.0), np.where(q[0] > 0, db, 0.0)
        w = p[0] * q[0] / safe
        share = q[0] / safe
        return [
            n,
            np.where(p[0] > 0, p[1] + da * share, q[1]), np.where(p[0] > 0, p[2] + db * share, q[2]),
            p[3] + q[3] + da * da * w, p[4] + q[4] + db * db * w, p[5] + q[5] + da * db * w,
        ]

    def moments(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        acc = None
        for pdf in batches:
            part = of_batch(pdf.to_numpy(dtype=float))
            acc = part if acc is None else merge(acc, part)
        if acc is not None:
            yield pd.DataFrame({"pair": np.arange(len(ia)), **dict(zip(_MOMENTS, acc))})

    return x.mapInPandas(moments, "pair int, " + ", ".join(f"{m} double" for m in _MOMENTS))


def correlation_pairs(
    df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]]
) -> DataFrame:
    """Pearson r and row count of each pair over the rows complete in both; constants give null.

    The table is read once. The moments of the tasks, one small row per pair and task, are staged: their
    overall means come first, then each task's products are moved to them.
    """
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, n bigint, r double")
    parts = stage(_task_moments(df, columns, pairs))
    n = F.col("n")
    means = parts.groupBy("pair").agg(
        F.sum("n").alias("all"),
        F.try_divide(F.sum(n * F.col("ma")), F.sum("n")).alias("mean_a"),
        F.try_divide(F.sum(n * F.col("mb")), F.sum("n")).alias("mean_b"),
    )
    da, db = F.col("ma") - F.col("mean_a"), F.col("mb") - F.col("mean_b")
    sums = parts.join(means, "pair").groupBy("pair").agg(
        F.max("all").alias("n"),
        F.max("mean_a").alias("mean_a"),
        F.max("mean_b").alias("mean_b"),
        F.sum(F.col("caa") + F.coalesce(n * da * da, F.lit(0.0))).alias("va"),
        F.sum(F.col("cbb") + F.coalesce(n * db * db, F.lit(0.0))).alias("vb"),
        F.sum(F.col("cab") + F.coalesce(n * da * db, F.lit(0.0))).alias("cov"),
    )

    def flat(v: str, mean: str) -> Column:
        # a spread of 1e-13 of the size of the values is rounding noise of a constant column
        return F.col(v) <= n * F.pow(F.col(mean) * 1e-13, F.lit(2.0))

    r = F.try_divide(F.col("cov"), F.sqrt("va") * F.sqrt("vb"))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    known = (n > 0) & ~flat("va", "mean_a") & ~flat("vb", "mean_b")
    name = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), F.col("pair") + 1)
    return sums.select(
        name(0).alias("a"), name(1).alias("b"), n.cast("bigint").alias("n"), F.when(known, r).alias("r")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle of the correlation matrix in long form (a, b, n, r)."""
    return correlation_pairs(df, columns, list(combinations(columns, 2)))


def churn_target(outcome: str = OUTCOME) -> Column:
    """1 churned, 0 otherwise, null while Open."""
    return F.when(~F.col(outcome).eqNullSafe(F.lit(s.OPEN)), flag(F.col(outcome) == s.CHURNED))


def target_correlation(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Correlation of every column with the target, strongest positive first."""
    return (
        correlation_pairs(df, [*columns, target], [(c, target) for c in columns])
        .select(F.col("a").alias("column"), "n", "r", F.abs("r").alias("abs_r"))
        .orderBy(F.desc_nulls_last("r"), "column")
    )


def strongest(correlations: DataFrame, k: int) -> DataFrame:
    return correlations.orderBy(F.desc_nulls_last("abs_r"), "column").limit(k)


def collinear_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.7) -> DataFrame:
    return correlation_matrix(df, columns).where(F.abs("r") > threshold)
