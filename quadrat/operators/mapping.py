"""Region labels of a source to the regions of the market."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.columns import clean_label


def last_wins(mapping: DataFrame, order: str) -> DataFrame:
    """One row for each label: of several, the last."""
    w = Window.partitionBy("label").orderBy(F.desc(order))
    return mapping.select(clean_label(F.col("label")).alias("label"), clean_label(F.col("region")).alias("to"), order).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("label", "to")


def map_regions(panel: DataFrame, universe: DataFrame, mapping: DataFrame, order: str = "position") -> DataFrame:
    """The panel with region: what the map says if that is a region of the market, else the label itself if it is one, else null."""
    known = universe.select(clean_label(F.col("region")).alias("u")).distinct()
    labels = panel.select(clean_label(F.col("region_raw")).alias("label")).distinct()
    to = labels.join(last_wins(mapping, order), "label", "left").join(known.withColumnRenamed("u", "mapped"), F.col("to") == F.col("mapped"), "left").join(known.withColumnRenamed("u", "direct"), F.col("label") == F.col("direct"), "left")
    final = to.select("label", F.coalesce("mapped", "direct").alias("region"))
    return panel.drop("region").join(final, clean_label(F.col("region_raw")) == F.col("label"), "left").drop("label")


def mapping_report(mapped: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: labels and rows, mapped and not, and regions of the market covered."""
    n = universe.select("region").distinct().count()
    return mapped.agg(F.countDistinct("region_raw").alias("labels"), F.countDistinct(F.when(F.col("region").isNull(), F.col("region_raw"))).alias("unmapped_labels"), F.count("*").alias("n_rows"), F.count_if(F.col("region").isNull()).alias("unmapped_rows"), F.countDistinct("region").alias("covered"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("region").isNull(), F.col("region_raw")))), ", ").alias("unmapped_list")).withColumn("universe", F.lit(n).cast("long"))


def uncovered(required: DataFrame, mapped: DataFrame) -> DataFrame:
    """Required regions that no row is mapped to."""
    return required.select("region").distinct().join(mapped.select("region").where("region is not null").distinct(), "region", "left_anti")
