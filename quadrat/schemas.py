"""Schemas and error types of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

CANONICAL = T.StructType([
    T.StructField("region", T.StringType()), T.StructField("region_raw", T.StringType()), T.StructField("date", T.DateType()), T.StructField("metric", T.StringType()),
    T.StructField("metric_name", T.StringType()), T.StructField("kpi", T.DoubleType()), T.StructField("selected_aggregation", T.StringType()),
    T.StructField("source_data_fingerprint", T.StringType()), T.StructField("source_row_count", T.LongType()),
])


class QuadratError(ValueError):
    """Base of the errors that a user can correct."""


class UnreadableSource(QuadratError):
    pass


class UnreadableWorkbook(UnreadableSource):
    pass


class NoDateColumns(QuadratError):
    pass


class NoMetricColumn(QuadratError):
    pass


class NoPopulationColumn(QuadratError):
    pass


class AmbiguousLayout(QuadratError):
    pass


class NoObservations(QuadratError):
    pass


class DuplicateKeys(QuadratError):
    pass
