"""Event streams into a daily KPI panel, with a watermark for late data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)


def daily_panel(events: DataFrame, late: str = "2 days") -> DataFrame:
    """region, date, kpi, n by day; a day is final once the watermark has passed it."""
    w = F.window("ts", "1 day")
    sums = events.withWatermark("ts", late).groupBy(w, F.col("event_type").alias("region")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("kpi"), F.count("*").alias("n"))
    return sums.select("region", F.to_date("window.start").alias("date"), "kpi", "n")


def run_once(panel: DataFrame, mode: str = "complete") -> DataFrame:
    """Drive the stream through all input that is there, and return what it gave."""
    name = f"quadrat_{uuid.uuid4().hex}"
    q = panel.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return panel.sparkSession.table(name)
