"""Exports. Tables are written by Spark; documents that are small by nature are JSON."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMINGS = ("runtime", "runtime_s", "started", "finished")


def geo_assignment(regions: DataFrame, tests: DataFrame, controls: DataFrame) -> DataFrame:
    """Market, reference label and region with Yes or nothing for test and control, sorted. regions: market, label, region."""
    flag = lambda d, name: d.select(F.col("region").alias(f"r_{name}")).distinct().withColumn(name, F.lit("Yes"))
    x = regions.distinct().join(flag(tests, "Test"), F.col("region") == F.col("r_Test"), "left").join(flag(controls, "Control"), F.col("region") == F.col("r_Control"), "left")
    return x.select("market", "label", "region", F.coalesce("Test", F.lit("")).alias("Test"), F.coalesce("Control", F.lit("")).alias("Control")).orderBy("market", "region")


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON document, missing values included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def write_csv(df: DataFrame, at: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(at)


def write_json(df: DataFrame, at: str) -> None:
    df.write.mode("overwrite").json(at)


def without_timing(df: DataFrame) -> DataFrame:
    """Evidence tables without the columns that differ from run to run."""
    return df.drop(*(c for c in df.columns if c in TIMINGS))


def chart_series(fitted: DataFrame, pre_end) -> DataFrame:
    """Date, Series, Value: actual and predicted values, and both as percent of their mean before ``pre_end``."""
    base = fitted.agg(*(F.avg(F.when(F.col("date") <= pre_end, F.col(c))).alias(f"b_{c}") for c in ("actual", "predicted")))
    x = fitted.join(F.broadcast(base))  # one row
    value: list[Column] = [F.col("actual"), F.col("predicted"), F.col("actual") / F.col("b_actual") * 100, F.col("predicted") / F.col("b_predicted") * 100]
    names = ("Actual", "Predicted", "Actual indexed", "Predicted indexed")
    return x.select("date", F.inline(F.array(*(F.struct(F.lit(n).alias("series"), v.alias("value")) for n, v in zip(names, value, strict=True)))))


def shared_dir(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode, where it is unset, a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quadrat-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, what: str = "part") -> DataFrame:
    """The rows, written to the shared folder and read again: a short plan, and nothing to compute anew when an executor is lost."""
    at = f"{shared_dir(df.sparkSession)}/quadrat/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
