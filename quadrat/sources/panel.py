"""KPI panels of the warehouse tables: regions or nations by week or month, and event types by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_panel(spark: SparkSession, sf_dir: str, level: str = "region", grain: str = "week") -> DataFrame:
    """region, date, revenue, orders: money is summed in decimals, so that no order of rows changes a digit.

    Orders are counted by customer's nation before the small dimensions are joined: the fact table meets the customers once,
    and only group sums go on.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date(F.date_trunc(grain, "o_orderdate")).alias("date"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sums = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "date").agg(F.sum("price").alias("revenue"), F.count("*").alias("orders"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.trim("n_name").alias("n_name"), "n_regionkey")
    named = sums.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    if level == "nation":
        return named.select(F.col("n_name").alias("region"), "date", F.col("revenue").cast("double").alias("revenue"), "orders")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.trim("r_name").alias("r_name"))
    wide = named.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region"), "date")  # 5 rows
    return wide.agg(F.sum("revenue").cast("double").alias("revenue"), F.sum("orders").alias("orders"))


def kpi(panel: DataFrame, metric: str = "revenue") -> DataFrame:
    """region, date, kpi of one metric."""
    return panel.select("region", "date", F.col(metric).cast("double").alias("kpi"))


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region (the event type), date, kpi (decimal sum of values), n, by day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("region"), F.to_date("ts").alias("date")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("kpi"), F.count("*").alias("n"))


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region (nation), Population and features: shares of market segments, mean balance, suppliers; a region without customers is absent."""
    c = table(spark, sf_dir, "customer")
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    shares = [(F.count_if(F.col("c_mktsegment") == s) / F.count("*")).alias(f"share_{s.lower()}") for s in segments]
    base = c.groupBy("c_nationkey").agg(F.count("*").cast("double").alias("Population"), (F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("mean_balance"), *shares)
    sup = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").cast("double").alias("suppliers"))
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", F.trim("n_name").alias("region"), "n_regionkey"))  # 25 rows
    return base.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(sup, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("region", "n_regionkey", "Population", "mean_balance", "suppliers", *(f"share_{s.lower()}" for s in segments))
