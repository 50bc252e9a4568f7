"""CSV sources and the file sinks of the pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renewlens import schema as s
from renewlens.functions import scalars as fn
from renewlens.operators.cleaning import conform
from renewlens.sources.quoted_csv import read_quoted_csv


def normalise_nulls(df: DataFrame, tokens: Sequence[str] = s.NULL_TOKENS) -> DataFrame:
    """Missing-value spellings become null in every text column, in one projection."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: fn.null_token_to_null(fn.quoted(c), tokens) for c in text})


def read_text_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header CSV with every column as text: no type inference pass over the data.

    Large files are split between tasks. Files whose quoted fields contain line breaks need
    ``multi_line``: a further pass over the quotes finds where records start, and the files are split
    all the same. :func:`broken_quotes` finds such files.
    """
    if multi_line:
        return read_quoted_csv(spark, path)
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def broken_quotes(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines of the files and lines with an odd number of quotes.

    A line with an odd number opens or closes a field that goes over a line break, so any such line
    means that the files have to be read with ``multi_line`` or are damaged.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(path).agg(
        F.count("*").alias("n_lines"), F.count_if(quotes % 2 == 1).alias("n_broken")
    )


def read_table(spark: SparkSession, path: str, name: str, multi_line: bool = False) -> DataFrame:
    return conform(normalise_nulls(read_text_csv(spark, path, multi_line)), s.TABLES[name])


def read_billings(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_table(spark, path, "billings", multi_line)


def read_cc_calls(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_table(spark, path, "cc_calls", multi_line)


def read_emails(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_table(spark, path, "emails", multi_line)


def read_renewal_calls(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_table(spark, path, "renewal_calls", multi_line)


def read_all(spark: SparkSession, folder: str, multi_line: bool = False) -> dict[str, DataFrame]:
    return {n: read_table(spark, f"{folder}/{n}.csv", n, multi_line) for n in s.TABLES}


def write_features(df: DataFrame, path: str, partition_by: str | None = "Renewal_Year") -> None:
    """Feature table as parquet; nullable integers are filled with 0, missing text stays null."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    df = df.fillna(0, subset=[c for c in ints if c != partition_by])
    writer = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def refresh_features(df: DataFrame, path: str, partition_by: str = "Renewal_Year") -> None:
    """Replace the years that ``df`` has in a stored feature table; the files of other years stay.

    Features of a year depend on that year's rows alone (quartiles included), so a new year, or a year
    with late calls, is built by itself with ``years=[...]`` and refreshed here.
    """
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    filled = df.fillna(0, subset=[c for c in ints if c != partition_by])
    writer = filled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(partition_by).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_keyed(
    df: DataFrame, name: str, path: str, buckets: int, key: Sequence[str] = ("Co_Ref", "Renewal_Year")
) -> DataFrame:
    """Store a table bucketed and sorted by its key, and return it as the catalog has it.

    Tables stored with the same number of buckets join and group on that key without a shuffle, as often
    as they are read. Each bucket is one sorted file, so size ``buckets`` for about 128 MB each. Event
    tables are stored after their reduction to one row per key, or by (customer, year) if no customer
    has more events than a bucket should hold. An existing table of that name is replaced.
    """
    spark = df.sparkSession
    writer = df.repartition(buckets, *key).write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)
    return spark.table(name)


def write_feature_list(spark: SparkSession, names: Sequence[str], path: str) -> None:
    row = spark.createDataFrame([(list(names),)], "features array<string>")
    row.coalesce(1).write.mode("overwrite").json(path)


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    return spark.read.schema("features array<string>").json(path).first()["features"]


def row_key(df: DataFrame) -> list[str]:
    """The columns that name a row: customer and, where the table has it, renewal year."""
    return [c for c in ("Co_Ref", "Renewal_Year") if c in df.columns]


def write_predictions(df: DataFrame, path: str) -> None:
    """Score table, highest risk first across and within the part files."""
    (
        df.orderBy(F.desc("churn_probability"), *row_key(df))
        .withColumn("churn_probability", F.round("churn_probability", 4))
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )


def report_columns(df: DataFrame) -> DataFrame:
    """Hypothesis table with the published headers and marks, as text where marks need it.

    The lift is marked as absent unless churn at 0 is above nothing. It is computed from the unrounded
    rates, so it is missing exactly there or where the feature is never 1.
    """
    never_one = F.col("churn_if_1").isNull() & F.col("churn_if_0").isNotNull()
    no_lift = (F.col("test") == "Chi-square") & F.col("lift").isNull() & ~never_one
    marked = df.withColumns({
        "lift": F.when(no_lift, s.NO_LIFT).otherwise(F.col("lift").cast("string")),
        "significant": F.when(F.col("significant"), s.SIGNIFICANT_MARK).otherwise(
            s.NOT_SIGNIFICANT_MARK
        ),
    })
    return marked.select(*[F.col(c).alias(h) for c, h in s.SUMMARY_HEADERS.items()])


def write_test_summary(df: DataFrame, path: str) -> None:
    """Result table of the tests; a hypothesis table gets its published headers."""
    if set(s.SUMMARY_HEADERS) <= set(df.columns):
        df = report_columns(df)
    df.write.mode("overwrite").option("header", True).csv(path)
