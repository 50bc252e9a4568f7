"""Registered queries: a Spark plan over the given tables and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.checks import standin
from renewlens.checks.oracles import with_tables
from renewlens.functions.scalars import flag
from renewlens.operators import cleaning
from renewlens.plans.features import build_cohort_features


class Tables:
    """Lazily built tables of one query run."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def source(self, name: str) -> DataFrame:
        return standin.table(self.spark, self.folder, name)

    @cached_property
    def raw_billings(self) -> DataFrame:
        return standin.billings(self.spark, self.folder)

    @cached_property
    def raw_cc(self) -> DataFrame:
        return standin.cc_calls(self.spark, self.folder)

    @cached_property
    def raw_rc(self) -> DataFrame:
        return standin.renewal_calls(self.spark, self.folder)

    @cached_property
    def raw_emails(self) -> DataFrame:
        return standin.emails(self.spark, self.folder)

    @cached_property
    def bills(self) -> DataFrame:
        return cleaning.clean_billings(self.raw_billings)

    @cached_property
    def cc(self) -> DataFrame:
        return cleaning.clean_cc_calls(self.raw_cc)

    @cached_property
    def rc(self) -> DataFrame:
        return cleaning.clean_renewal_calls(self.raw_rc)

    @cached_property
    def emails(self) -> DataFrame:
        return cleaning.clean_emails(self.raw_emails)

    @cached_property
    def features(self) -> DataFrame:
        return build_cohort_features(self.bills, self.cc, self.rc)

    @cached_property
    def decided(self) -> DataFrame:
        """Decided renewals with label, a score in [0, 1) and the price change."""
        last = F.col("Last_Total_Net_Paid")
        return self.bills.where(F.col("Prospect_Outcome").isin("Won", "Churned")).withColumns({
            "label": flag(F.col("Prospect_Outcome") == "Churned"),
            "p": (F.col("Renewal_Score_At_Release") + 1000) / 11000,
            "change": F.try_divide(F.col("Total_Net_Paid") - last, last),
        })

    @cached_property
    def scored(self) -> DataFrame:
        return self.decided.where(F.col("p").isNotNull()).select(
            "Co_Ref", "Renewal_Year", F.col("p").alias("score"), "label"
        )


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None
    floats: tuple[str, ...]
    covers: tuple[str, ...]

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.run(Tables(spark, folder))
        # adding zero turns a rounded -0.0 into 0.0
        return df.withColumns({c: F.round(F.col(f"`{c}`"), 6) + F.lit(0.0) for c in self.floats})


QUERIES: dict[str, Query] = {}


def query(
    covers: str, body: str | None = None, tables: Sequence[str] = (), floats: Sequence[str] = ()
):
    """Register a function of :class:`Tables` under its own name.

    ``covers`` lists the inventory items it exercises, ``body`` is the oracle over ``tables``.
    """

    def register(run: Callable[[Tables], DataFrame]):
        sql = with_tables(body, *tables, floats=floats) if body is not None else None
        if run.__name__ in QUERIES:
            raise ValueError(f"query {run.__name__} is registered twice")
        QUERIES[run.__name__] = Query(run, sql, tuple(floats), tuple(covers.split()))
        return run

    return register
