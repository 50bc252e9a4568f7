"""Retention tables derived from the driver's benchmark tables.

Every view is a Spark plan over whole input tables. The same rows are described in SQL in
``checks/oracles.py``. Per-key picks are min-of-struct aggregates instead of row numbers, so a customer
with a third of all orders is reduced before the shuffle. Both sides of the order-line join grow with
the data, so it is a shuffled join at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def billings(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice",
        F.year("o_orderdate").alias("yr"),
    )
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_discount",
        "l_quantity", "l_returnflag",
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")

    # first order line per customer and year: the struct compares field by field
    pick = F.min(F.struct(
        F.when(F.col("l_shipdate") > F.col("o_orderdate"), 0).otherwise(1).alias("late"),
        "l_shipdate", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "o_orderdate", "o_orderstatus", "o_totalprice", "l_discount", "l_quantity",
        "l_returnflag",
    )).alias("p")
    first = (
        orders.join(lines.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "yr")
        .agg(pick)
        .select("o_custkey", "yr", "p.*")
        .join(customers, F.col("c_custkey") == F.col("o_custkey"))
    )
    first = first.selectExpr(
        "*",
        """case when o_orderkey % 29 = 0 then null when c_mktsegment = 'AUTOMOBILE' then 'Band A'
             when c_mktsegment = 'BUILDING' then 'Band C1' when c_mktsegment = 'FURNITURE' then 'Group'
             when o_orderkey % 3 = 0 then 'Band F2' when o_orderkey % 3 = 1 then 'Band Z'
             else 'Band J' end as band""",
    )
    # at most one row per customer and year is left, so these windows are short
    return first.selectExpr(
        "o_custkey as Co_Ref",
        "yr as Renewal_Year",
        "o_orderdate as Prospect_Renewal_Date",
        "l_shipdate as Closed_Date",
        """case o_orderstatus when 'F' then 'Won' when 'P' then 'Churned' else 'Open' end
             as Prospect_Outcome""",
        "band as Band",
        "lag(band) over (partition by o_custkey order by yr) as Last_Band",
        "o_totalprice as Total_Net_Paid",
        "lag(o_totalprice) over (partition by o_custkey order by yr) as Last_Total_Net_Paid",
        "yr - min(yr) over (partition by o_custkey) as Tenure_Years",
        "l_linenumber - 1 as Current_Anchorings",
        "l_quantity as Connection_Qty",
        "l_discount as Discount_Amount",
        """case when o_orderkey % 13 = 0 then null when l_returnflag = 'A' then ' y '
             when l_returnflag = 'N' then 'n' when o_orderkey % 2 = 0 then 'yes' else 'Yes' end
             as Current_Auto_Renewal_Flag""",
        "case when o_orderkey % 11 <> 0 then c_acctbal end as Renewal_Score_At_Release",
        """case o_orderkey % 5 when 0 then ' unknown' when 1 then 'Card' else 'direct debit ' end
             as Payment_Method""",
    )


def cc_calls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "user_id * 10 + event_id % 10 as Co_Ref",
        "cast(1995 + event_id % 7 as int) as Call_Year",
        "ts as Call_Date",
        """case when event_type in ('click', 'view', 'error') then ' IN_BOUND' else 'OUT_BOUND ' end
             as Direction""",
        """case (event_id * 7 + 3) % 9 when 0 then 'Yes' when 1 then ' yes' when 2 then 'No'
             when 3 then 'Not Discussed' when 4 then null
             when 5 then 'The caller explained at length that it was unclear' when 6 then 'TRUE'
             when 7 then '0' else 'n' end as cc_contractor_suggest_leave""",
        """case (event_id * 5 + 1) % 8 when 0 then 'Yes' when 1 then null when 2 then 'Not applicable'
             else 'No' end as cc_contractor_complained""",
        "case when event_type = 'error' then 'Yes' else 'No' end as cc_platform_issues",
        """case event_id % 6 when 0 then 'Satisfied' when 1 then 'Neutral' when 2 then 'Dissatisfied'
             when 3 then 'Not Discussed' when 4 then null
             else 'Customer began unhappy and then relaxed' end as cc_contractor_sentiment""",
        """case when event_id % 6 = 0 then 'Not Discussed' when event_id % 17 = 0 then null
             else cast((event_id * 37) % 101 as string) end
             as cc_contractor_sentiment_start_score""",
        """case when event_id % 10 = 0 then '' when event_id % 19 = 0 then 'n/k'
             else cast((event_id * 53) % 101 as string) end as cc_contractor_sentiment_end_score""",
    )


def renewal_calls(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_custkey", "year(o_orderdate) as yr"
    ).where("(o_custkey + yr) % 4 <> 0")
    return (
        table(spark, folder, "lineitem")
        .hint("merge")
        .join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .selectExpr(
            "case when l_partkey % 97 <> 0 then o_custkey end as Co_Ref",
            "yr as Call_Year",
            "cast(l_linenumber as string) as Call_Number",
            """case l_partkey % 6 when 0 then 'Outbound' when 1 then 'OUT_BOUND' when 2 then 'Inbound'
                 when 3 then ' in_bound ' when 4 then null else 'transfer' end as Call_Direction""",
            """case (l_partkey * 3 + l_suppkey) % 14
                 when 0 then 'Yes (asked if the price could be dropped)' when 1 then '[No]'
                 when 2 then '**no**' when 3 then 'Not applicable' when 4 then 'XXXX'
                 when 5 then 'Customer said yes, but later' when 6 then 'Well, no thanks'
                 when 7 then 'Not sure' when 8 then null when 9 then 'UNAVAILABLE' when 10 then 'Yes'
                 when 11 then 'Yesterday it was raised'
                 when 12 then 'A very long remark before the word yes' else 'No' end
                 as Discount_or_Waiver_Requested""",
            "case when l_discount > 0.08D then 'Yes' else 'No' end as Explicit_Switching_Intent",
            """case when l_tax > 0.06D then 'Yes' when l_tax < 0.01D then null else 'No' end
                 as Explicit_Competitor_Mention""",
            "case l_returnflag when 'R' then 'Yes' else 'No' end as Call_Reschedule_Request",
            """case when l_linestatus = 'F' then 'Yes/No' when l_quantity > 25 then 'Yes' else 'No' end
                 as Membership_Renewal_Decision""",
        )
    )


def emails(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_custkey as Co_Ref",
        "year(o_orderdate) + 1 as year",
        """case o_orderpriority when '1-URGENT' then 'pre_renewal' when '2-HIGH' then ' 14_out'
             when '3-MEDIUM' then '45_out ' else 'prior_year' end as Time_to_Renewal""",
        """case o_orderkey % 9 when 0 then 'Satisfied' when 1 then 'Neutral' when 2 then 'not discussed'
             when 3 then 'Dissatisfied' when 4 then 'Initially dissatisfied, later neutral'
             when 5 then 'Yes' when 6 then null
             when 7 then 'The contractor wrote a very long message about many things'
             else ' positive ' end as crm_contractor_sentiment""",
        """case when o_orderkey % 7 = 0 then 'none' else cast(o_orderkey % 5 as string) end
             as crm_agent_chase_count""",
        """case o_orderkey % 4 when 0 then 'Yes' when 1 then 'No' when 2 then 'Not Discussed'
             else null end as crm_customer_complained""",
    )


def dates_raw(spark: SparkSession, folder: str) -> DataFrame:
    d, key = F.col("o_orderdate"), F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_orderdate",
        (key % 4 < 3).alias("parse_ok"),
        F.when(key % 4 == 0, F.date_format(d, "dd-MM-yyyy"))
        .when(key % 4 == 1, F.date_format(d, "d/M/yyyy"))
        .when(key % 4 == 2, F.date_format(d, "yyyy-MM-dd"))
        .otherwise("unknown")
        .alias("date_raw"),
    )


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "billings": billings(spark, folder),
        "cc_calls": cc_calls(spark, folder),
        "emails": emails(spark, folder),
        "renewal_calls": renewal_calls(spark, folder),
    }
