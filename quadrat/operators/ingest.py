"""From wide KPI frames to the canonical panel: layout, melt, typing, rejects, aggregation and quality."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.columns import clean_label, number, row_digest
from quadrat.schemas import AmbiguousLayout, DuplicateKeys, NoDateColumns, NoMetricColumn

_FORMATS = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y", "%d %b %Y", "%Y%m%d")


def header_date(name: str) -> date | None:
    """The date that a column header names, if it names one."""
    name = name.strip()
    if len(name) < 6 or not re.search(r"\d", name):
        return None
    for f in _FORMATS:
        try:
            return datetime.strptime(name, f).date()
        except ValueError:
            continue
    return None


def date_columns(columns: list[str]) -> dict[str, date]:
    return {c: d for c in columns if (d := header_date(c))}


@dataclass(frozen=True)
class Layout:
    region: str
    metric: str | None
    dates: dict[str, date]
    aggregation: str | None = None


def resolve_layout(columns: list[str], aggregation: str | None = None, metric: str | None = None) -> Layout:
    """Simple frames have at most two columns that aren't dates, region and metric; others need both named."""
    dates = date_columns(columns)
    if not dates:
        raise NoDateColumns("no column header is a date")
    other = [c for c in columns if c not in dates]
    found = metric or next((c for c in other if c.strip().lower() == "metric"), None)
    if metric and metric not in other:
        raise NoMetricColumn(f"there is no column {metric!r}")
    if len(other) <= 2:
        region = next((c for c in other if c != found), None)
        if region is None:
            raise AmbiguousLayout("no column is left for regions")
        return Layout(region, found, dates)
    if aggregation is None:
        raise AmbiguousLayout("several columns could be the region; name the aggregation column")
    if aggregation not in other:
        raise AmbiguousLayout(f"there is no column {aggregation!r}")
    if found is None:
        raise NoMetricColumn("no metric column is named or found")
    return Layout(aggregation, found, dates, aggregation)


def melt(wide: DataFrame, layout: Layout) -> DataFrame:
    """region_raw, metric_name, date_raw, kpi_raw: a row for each cell, missing ones too."""
    keys = [clean_label(F.col(f"`{layout.region}`")).alias("region_raw"), (clean_label(F.col(f"`{layout.metric}`")) if layout.metric else F.lit("kpi")).alias("metric_name")]
    cells = wide.select(*keys, *(F.col(f"`{c}`").cast("string").alias(d.isoformat()) for c, d in layout.dates.items()))
    return cells.unpivot(["region_raw", "metric_name"], [d.isoformat() for d in layout.dates.values()], "date_raw", "kpi_raw")


def typed(long: DataFrame) -> DataFrame:
    """Adds date, kpi and reject: null, 'blank region', 'invalid date', 'missing value' or 'non-numeric value'."""
    out = long.withColumn("date", F.col("date_raw").try_cast("date")).withColumn("kpi", number(F.col("kpi_raw")))
    blank = F.col("kpi_raw").isNull() | (F.trim("kpi_raw") == "")
    reason = F.when(F.col("region_raw") == "", "blank region").when(F.col("date").isNull(), "invalid date").when(blank, "missing value").when(F.col("kpi").isNull(), "non-numeric value")
    return out.withColumn("reject", reason)


def rejects(long: DataFrame) -> DataFrame:
    """Rows that carry no number for a region and date, with the reason."""
    return typed(long).where("reject is not null and reject != 'blank region'").select("region_raw", "metric_name", "date_raw", "kpi_raw", "reject")


def canonical(long: DataFrame, aggregation: str | None = None, fingerprint: str = "") -> DataFrame:
    """The canonical panel: a sum by region, metric and date, missing where every value is missing, with the rows behind it."""
    own = typed(long).where("region_raw != '' and date is not null")
    sums = own.groupBy(F.col("region_raw").alias("region"), F.lower("metric_name").alias("metric"), "date").agg(F.min("metric_name").alias("metric_name"), F.sum("kpi").alias("kpi"), F.count("*").alias("source_row_count"))
    return sums.select("region", F.col("region").alias("region_raw"), "date", "metric", "metric_name", "kpi", F.lit(aggregation).cast("string").alias("selected_aggregation"), F.lit(fingerprint).alias("source_data_fingerprint"), "source_row_count")


def quality_report(long: DataFrame) -> DataFrame:
    """One row of counters, in one pass over the cells."""
    t = typed(long)
    key = F.struct("region_raw", "metric_name", "date_raw")
    return t.agg(
        F.count("*").alias("n_cells"), F.count_if(F.col("region_raw") == "").alias("n_blank_region"), F.count_if(F.coalesce(F.col("reject"), F.lit("")) == "invalid date").alias("n_invalid_date"),
        F.count_if(F.col("kpi_raw").isNull() | (F.trim("kpi_raw") == "")).alias("n_missing"), F.count_if(F.col("reject") == "non-numeric value").alias("n_non_numeric"),
        F.count_if(F.col("kpi") == 0).alias("n_zero"), F.count_if(F.col("kpi") < 0).alias("n_negative"), F.count_if(F.col("reject").isNull()).alias("n_retained"),
        F.countDistinct(F.when(F.col("region_raw") != "", F.col("region_raw"))).alias("n_regions"), F.countDistinct(F.lower("metric_name")).alias("n_metrics"), F.countDistinct("date").alias("n_dates"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), (F.count("*") - F.countDistinct(key)).alias("n_repeated_keys"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with several rows, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The frame itself, or an error that names some of the repeated keys."""
    some = duplicate_keys(df, keys).orderBy(*keys).limit(5).collect()
    if some:
        raise DuplicateKeys(f"repeated keys: {[tuple(r[k] for k in keys) for r in some]}")
    return df


def to_wide(panel: DataFrame, dates: list[date]) -> DataFrame:
    """A row for each region, a column for each date; the values are given, so that no job looks for them."""
    return panel.groupBy("region").pivot("date", dates).agg(F.first("kpi", ignorenulls=True))


def period_quality(panel: DataFrame, definite_coverage: float = 0.9, possible_zero: float = 0.8, missing_coverage: float = 0.5) -> DataFrame:
    """By date: regions expected, observed and at zero, total, and the class of the period."""
    regions = panel.agg(F.countDistinct("region").alias("expected"))
    by_date = panel.groupBy("date").agg(F.count("kpi").alias("observed"), F.count_if(F.col("kpi") == 0).alias("zeros"), F.sum("kpi").alias("total"))
    both = by_date.join(F.broadcast(regions))  # one row
    coverage, zero = F.col("observed") / F.col("expected"), F.coalesce(F.try_divide("zeros", "observed"), F.lit(0.0))
    some = F.col("observed") > 0
    kind = F.when(coverage < missing_coverage, "missing_market_wide_period").when(some & (coverage >= definite_coverage) & (zero >= 1), "definite_market_wide_zero").when(some & (zero >= possible_zero), "possible_widespread_outage").otherwise("normal")
    return both.select("date", "expected", "observed", coverage.alias("coverage"), "zeros", zero.alias("zero_share"), "total", kind.alias("period_class"))


def gaps(panel: DataFrame, by: list[str]) -> DataFrame:
    """by, date and gap: days since the date before."""
    w = Window.partitionBy(*by).orderBy("date")
    return panel.select(*by, "date").distinct().withColumn("gap", F.datediff("date", F.lag("date").over(w)))


def cadence(panel: DataFrame, by: list[str]) -> DataFrame:
    """by, n_dates, gcd_gap and median_gap, cadence by each, and whether the dates are contiguous at the median."""
    from quadrat.functions.columns import gcd_fold

    g = gaps(panel, by).groupBy(*by).agg(F.count("*").alias("n_dates"), F.array_sort(F.collect_list("gap")).alias("gaps"), F.median("gap").alias("median_gap"))
    kind = lambda c: F.when(c.between(0.5, 1.5), "daily").when(c.between(5.5, 8.5), "weekly").otherwise("unknown")
    gcd = gcd_fold(F.col("gaps"))
    return g.select(*by, "n_dates", gcd.alias("gcd_gap"), "median_gap", kind(gcd).alias("gcd_cadence"), kind(F.col("median_gap")).alias("median_cadence"), F.forall("gaps", lambda x: x == F.col("median_gap")).alias("contiguous"), F.size(F.filter("gaps", lambda x: x > 1.5 * F.col("median_gap"))).alias("n_breaks"))


def missing_dates(panel: DataFrame, by: list[str], days: int = 7) -> DataFrame:
    """by, date: dates between a series' first and last, ``days`` apart, that it lacks."""
    spans = panel.groupBy(*by).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    spine = spans.select(*by, F.explode(F.expr(f"sequence(lo, hi, interval {days} day)")).alias("date"))
    return spine.join(panel.select(*by, "date").distinct(), [*by, "date"], "left_anti")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: a digest of the rows as a multiset, and of names and types; no order of rows changes it, and no sort is needed."""
    digest = row_digest(*df.columns)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(5)]
    head = ",".join(f"{c}:{t}" for c, t in df.dtypes)
    return df.agg(F.sha2(F.concat_ws("|", F.lit(head), F.count("*").cast("string"), *parts), 256).alias("fingerprint"), F.count("*").alias("n_rows"))
