"""Column functions: labels, numbers, dates, fingerprints. All of them stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The error tokens of spreadsheets.
ERROR_TOKENS = ("#N/A", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NULL!", "#NUM!")


def clean_label(c: Column) -> Column:
    """Trimmed; null is an empty label."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def drop_error_tokens(c: Column) -> Column:
    return F.when(~F.trim(c).isin(*ERROR_TOKENS), c)


def number(c: Column) -> Column:
    """A finite number, or null: not a number and infinities are missing."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def day(c: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(c, fmt) if hasattr(F, "try_to_date") else F.try_to_timestamp(c, F.lit(fmt)).cast("date")


def looks_numeric(c: Column) -> Column:
    return c.rlike(r"^[\d\-\.,]+$")


def valid(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def kpi_feature_label(c: Column) -> Column:
    """wk_20240107 to 07 Jan 24."""
    return F.when(c.rlike(r"^wk_\d{8}$"), F.date_format(F.to_date(F.substring(c, 4, 8), "yyyyMMdd"), "dd MMM yy")).otherwise(c)


def lag_term(feature: Column) -> Column:
    """Of <control>_lagN: struct of region and lag; lag 0 without the ending."""
    n = F.regexp_extract(feature, r"^(.*)_lag(\d+)$", 2)
    return F.struct(F.when(n != "", F.regexp_extract(feature, r"^(.*)_lag(\d+)$", 1)).otherwise(feature).alias("region"), F.coalesce(n.try_cast("int"), F.lit(0)).alias("lag"))


def period_count(first: Column, last: Column, days: int) -> Column:
    """Periods of ``days`` days from the first date to the last, both included."""
    return F.floor(F.datediff(last, first) / days) + 1


def gcd_fold(gaps: Column) -> Column:
    """The greatest common divisor of an array of whole numbers (null if empty), by Euclid's steps in a fold."""
    def euclid(a: Column, b: Column) -> Column:
        # each fold step runs a bounded number of remainders; gaps of days have few digits
        pair = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")), lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), F.pmod(p["x"], F.when(p["y"] == 0, 1).otherwise(p["y"])).alias("y"))))
        return pair["x"]

    return F.when(F.size(gaps) > 0, F.aggregate(gaps, F.lit(0).cast("int"), lambda a, g: euclid(a, g.cast("int"))))


def row_digest(*columns: str) -> Column:
    """SHA-256 of typed cells: 1 and "1" differ, and no separator can be taken for content."""
    cells = [F.struct(F.typeof(F.col(c)).alias("k"), F.col(c).cast("string").alias("v")) for c in columns]
    return F.sha2(F.to_json(F.struct(*(x.alias(f"c{n}") for n, x in enumerate(cells))), {"ignoreNullFields": "false"}), 256)


def repaired_text(c: Column) -> Column:
    """Trimmed, double hyphens as dashes, wrongly decoded UTF-8 put right where that is possible, composed (NFC)."""

    def repair(v: str | None) -> str | None:
        if v is None:
            return None
        v = v.strip()
        try:
            v = v.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass  # the text was not wrongly decoded
        return unicodedata.normalize("NFC", v.replace("--", "–"))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(repair, na_action="ignore")

    return run(c)


def interpolated(points: Column, x: Column) -> Column:
    """The value at x of the line through sorted points (array of x, y); beyond the ends, that of the end."""
    below = F.filter(points, lambda p: p["x"] <= x)
    above = F.filter(points, lambda p: p["x"] > x)
    a, b = F.element_at(below, -1), F.get(above, 0)
    return F.when(F.size(below) == 0, F.get(points, 0)["y"]).when(F.size(above) == 0, F.element_at(points, -1)["y"]).otherwise(a["y"] + (x - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"]))
