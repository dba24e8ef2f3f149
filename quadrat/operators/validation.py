"""Validation of a counterfactual: matrix, lags, folds, placebo windows, error metrics, confidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions import numeric

#: Periods by frequency.
FREQUENCY = {"weekly": {"days": 7, "lag": 1, "min_train": 13, "horizon": 4}, "daily": {"days": 1, "lag": 7, "min_train": 84, "horizon": 28}}
MAX_FOLDS = 20
MAX_PLACEBOS = 40


def test_series(panel: DataFrame, tests: list[str], composition: str = "partial") -> DataFrame:
    """date, test_kpi: the sum of the test regions. partial: missing values count as nothing; complete: every region is needed."""
    own = panel.where(F.col("region").isin(*tests)).groupBy("date")
    if composition == "complete":
        return own.agg(F.when(F.count("kpi") == len(tests), F.sum("kpi")).alias("test_kpi"))
    return own.agg(F.coalesce(F.sum("kpi"), F.lit(0.0)).alias("test_kpi"))


def calendar_lags(panel: DataFrame, lags: list[int], days: int) -> DataFrame:
    """region, date, lag, kpi: the value exactly lag periods before, joined by date; where that date is absent there is no row."""
    shifted = panel.select("region", F.col("kpi").alias("lagged"), F.col("date").alias("source_date"), F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    shifted = shifted.withColumn("date", F.date_add("source_date", (F.col("lag") * days).cast("int")))
    return panel.select("region", "date").join(shifted, ["region", "date"]).where("lagged is not null").select("region", "date", "lag", F.col("lagged").alias("kpi"))


def model_matrix(panel: DataFrame, tests: list[str], controls: list[str], lags: list[int] = (), days: int = 7) -> DataFrame:
    """date, test_kpi and a column for each control (and lag), only dates that have all of them."""
    values = panel.where(F.col("region").isin(*controls)).select("date", F.col("region").alias("term"), "kpi")
    terms = list(controls)
    if lags:
        lagged = calendar_lags(panel.where(F.col("region").isin(*controls)), lags, days)
        values = values.unionByName(lagged.select("date", F.concat("region", F.lit("_lag"), "lag").alias("term"), "kpi"))
        terms += [f"{c}_lag{n}" for c in controls for n in lags]
    wide = values.groupBy("date").pivot("term", terms).agg(F.first("kpi", ignorenulls=True))
    return test_series(panel, tests).join(wide, "date").dropna()


def durbin_watson(residuals: DataFrame, by: list[str]) -> DataFrame:
    """Sum of squared steps over sum of squares; null below three residuals or without spread."""
    w = Window.partitionBy(*by).orderBy("date") if by else Window.orderBy("date")
    d = residuals.withColumn("step", F.col("residual") - F.lag("residual").over(w))
    agg = [F.when(F.count("residual") >= 3, F.try_divide(F.sum(F.col("step") * F.col("step")), F.nullif(F.sum(F.col("residual") * F.col("residual")), F.lit(0.0)))).alias("durbin_watson")]
    return d.groupBy(*by).agg(*agg) if by else d.agg(*agg)


def smape_term(a: Column, p: Column) -> Column:
    d = (F.abs(a) + F.abs(p)) / 2
    return F.abs(a - p) / F.when(d == 0, 1e-8).otherwise(d)


def error_metrics(df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """smape, rmse, r2 and correlation by group, in two passes over the keys that Spark makes one."""
    a, p = F.col(actual), F.col(predicted)
    sse, mean = F.sum((a - p) * (a - p)), F.avg(a)
    own = df.groupBy(*by).agg((F.avg(smape_term(a, p)) * 100).alias("smape"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"), F.when(F.var_pop(a) > 0, 1 - sse / (F.var_pop(a) * F.count(a))).alias("r2"), F.corr(a, p).alias("correlation"), mean.alias("mean_actual"))
    return own


def window_starts(n: int, first: int, length: int, most: int) -> list[int]:
    """Starts of windows, strided when there are more than ``most``; the stride is a whole number, so the end may be left out."""
    starts = list(range(first, n - length + 1))
    return starts if len(starts) <= most else starts[:: len(starts) // most][:most]


def placebo_windows(fitted: DataFrame, length: int) -> DataFrame:
    """Tumbling windows over date, actual, predicted: bucket, uplift and percent, whole windows only."""
    idx = fitted.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # one series: a few hundred dates
    w = idx.groupBy(F.floor(F.col("i") / length).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("actual") - F.col("predicted")).alias("uplift"), F.sum("predicted").alias("base"))
    return w.where(F.col("n") == length).select("bucket", "uplift", (F.try_divide("uplift", "base") * 100).alias("uplift_pct"))


def power_curve(placebos: DataFrame, alpha: float = 0.05, column: str = "uplift_pct") -> DataFrame:
    """effect_pct, power_lift, power_drop: share of shifted placebos beyond the placebos' own quantiles; nothing below five placebos."""
    x = placebos.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).alias("p"))
    thr = x.agg(F.percentile("p", F.lit(1 - alpha)).alias("hi"), F.percentile("p", F.lit(alpha)).alias("lo"), F.count("*").alias("k"))
    grid = F.explode(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: i * F.lit(0.5))).alias("effect_pct")
    e, p = F.col("effect_pct"), F.col("p")
    rows = x.join(F.broadcast(thr)).where("k >= 5").select("p", "hi", "lo", grid)  # one row
    up, down = p * (1 + e / 100) + e, p * (1 - e / 100) - e
    return rows.groupBy("effect_pct").agg(F.avg(F.when(up > F.col("hi"), 1.0).otherwise(0.0)).alias("power_lift"), F.avg(F.when(down < F.col("lo"), 1.0).otherwise(0.0)).alias("power_drop"))


def first_hit(curve: DataFrame, column: str, target: float = 0.8) -> DataFrame:
    """One row: the smallest effect whose power reaches the target, or null."""
    return curve.agg(F.min(F.when(F.col(column) >= target, F.col("effect_pct"))).alias("mde_pct"))


def placebo_summary(placebos: DataFrame, observed: float) -> DataFrame:
    """Quantiles of placebo uplifts, and how extreme the observed uplift is among them."""
    u = F.col("uplift")
    mean = placebos.agg(F.avg("uplift").alias("m"))
    both = placebos.join(F.broadcast(mean))  # one row
    q = F.percentile("uplift", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = both.agg(q.alias("q"), F.percentile("uplift_pct", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("qp"), (F.avg(F.when(u < observed, 1.0).otherwise(0.0)) * 100).alias("percentile_rank"), F.avg(F.when(u >= observed, 1.0).otherwise(0.0)).alias("p_one_sided"), F.avg(F.when(F.abs(u - F.col("m")) >= F.abs(F.lit(observed) - F.col("m")), 1.0).otherwise(0.0)).alias("p_two_sided"), ((F.lit(observed) - F.avg("uplift")) / (F.stddev_pop("uplift") + 1e-12)).alias("z_score"), F.count("*").alias("n_placebos"))
    return out.select(F.get("q", 1).alias("median_uplift"), F.get("q", 0).alias("p2_5"), F.get("q", 2).alias("p97_5"), F.get("qp", 1).alias("median_pct"), F.get("qp", 0).alias("p2_5_pct"), F.get("qp", 2).alias("p97_5_pct"), "percentile_rank", "p_one_sided", "p_two_sided", "z_score", "n_placebos")


# bands: fixed values of the traffic lights

def _band(c: Column, low: float, moderate: float) -> Column:
    ok = c.isNotNull() & ~F.isnan(c)
    return F.when(~ok, "insufficient").when(c <= low, "low").when(c <= moderate, "moderate").otherwise("high")


def autocorrelation_band(dw: Column) -> Column:
    ok = dw.isNotNull() & ~F.isnan(dw)
    return F.when(~ok, "insufficient").when(dw.between(1.5, 2.5), "low").when(((dw >= 1.2) & (dw < 1.5)) | ((dw > 2.5) & (dw <= 2.8)), "moderate").otherwise("high")


def bands(df: DataFrame) -> DataFrame:
    """Of pre_smape, rolling_smape, durbin_watson and bias_pct: four bands, the confidence, and what drives it."""
    gap = F.col("rolling_smape") - F.col("pre_smape")
    own = df.withColumn("overfit_gap", gap).withColumn("error_band", _band(F.col("rolling_smape"), 10, 15)).withColumn("gap_band", _band(gap, 3, 5)).withColumn("autocorrelation_band", autocorrelation_band(F.col("durbin_watson"))).withColumn("bias_band", _band(F.abs("bias_pct"), 5, 10))
    second = F.array("gap_band", "autocorrelation_band", "bias_band")
    conf = F.when(F.col("error_band") == "high", "low").when(F.col("error_band") == "insufficient", "insufficient").when((F.col("error_band") == "moderate") | F.arrays_overlap(second, F.array(F.lit("high"), F.lit("moderate"))), "moderate").otherwise("high")
    names = (("error_band", "rolling validation error"), ("gap_band", "overfitting gap"), ("autocorrelation_band", "autocorrelation risk"), ("bias_band", "rolling bias"))
    flagged = F.concat(*(F.array_compact(F.array(*(F.when(F.col(c) == level, F.lit(f"{level} {n}")) for c, n in names))) for level in ("high", "moderate")))
    return own.withColumn("confidence", conf).withColumn("drivers", F.when(F.col("confidence") == "high", "validation checks passed").when(F.col("confidence") == "insufficient", "insufficient validation data").otherwise(F.array_join(flagged, " + ")))


# fits: a task each fold, window and method

def fit_windows(matrix: DataFrame, terms: list[str], methods: list[str], starts: list[int], length: int, kind: str, days: int = 7) -> DataFrame:
    """One row for each method and window: an expanding fit before the window, and its errors within.

    The matrix is a few hundred dates; a row of the task table names a method and a start, and each runs in a task of its own.
    """
    spark = matrix.sparkSession
    tasks = spark.createDataFrame([(m, int(s)) for m in methods for s in starts] or [], "method string, start int")
    ordered = matrix.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    rows = ordered.join(F.broadcast(tasks), F.col("i") < F.col("start") + length)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        method, start = pdf["method"].iloc[0], int(pdf["start"].iloc[0])
        train, test = pdf[pdf.i < start], pdf[pdf.i >= start]
        out = {"kind": kind, "method": method, "start": start, "train_periods": start}
        dates = pd.to_datetime(test["date"])
        if len(test) < length or (dates.diff().dropna().dt.days != days).any():
            return pd.DataFrame()
        model = numeric.fit_regularised(method, train[terms].to_numpy(float), train["test_kpi"].to_numpy(float), 3)
        y, p = test["test_kpi"].to_numpy(float), model.predict(test[terms].to_numpy(float))
        out |= numeric.window_errors(y, p) | {"used_cv": model.used_cv, "alpha": model.alpha, "l1_ratio": model.l1_ratio}
        return pd.DataFrame([out])

    schema = "kind string, method string, start int, train_periods int, smape double, rmse double, bias double, bias_pct double, uplift double, uplift_pct double, used_cv boolean, alpha double, l1_ratio double"
    return rows.groupBy("method", "start").applyInPandas(run, schema)


def fold_summary(folds: DataFrame) -> DataFrame:
    """By method, over folds with cross-validated penalties only."""
    cv = folds.where("used_cv")
    pct = F.percentile("uplift_pct", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = cv.groupBy("method").agg(F.count("*").alias("n_folds"), F.avg("smape").alias("smape_mean"), F.avg("rmse").alias("rmse_mean"), F.percentile("smape", F.lit(0.9)).alias("smape_p90"), F.avg("bias_pct").alias("bias_pct_mean"), pct.alias("q"), F.count("uplift_pct").alias("k"))
    return out.select("method", "n_folds", "smape_mean", "rmse_mean", "smape_p90", "bias_pct_mean", F.get("q", 1).alias("uplift_pct_median"), F.when(F.col("k") >= 2, F.get("q", 0)).alias("uplift_pct_lower"), F.when(F.col("k") >= 2, F.get("q", 2)).alias("uplift_pct_upper"))


def fit_series(matrix: DataFrame, terms: list[str], method: str, pre_end) -> DataFrame:
    """date, actual, predicted, residual, in_pre: one fit before ``pre_end``, predictions for all dates."""
    own = matrix.withColumn("k", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        pre = pd.to_datetime(pdf["date"]) <= pd.Timestamp(pre_end)
        model = numeric.fit_regularised(method, pdf.loc[pre, terms].to_numpy(float), pdf.loc[pre, "test_kpi"].to_numpy(float), 5)
        p = model.predict(pdf[terms].to_numpy(float))
        return pd.DataFrame({"date": pdf["date"], "actual": pdf["test_kpi"], "predicted": p, "residual": pdf["test_kpi"] - p, "in_pre": pre})

    return own.groupBy("k").applyInPandas(run, "date date, actual double, predicted double, residual double, in_pre boolean")
