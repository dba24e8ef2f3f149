"""The validation run of many markets and methods in one plan: designs as arrays, moments as window sums, fits from moments.

A run is a market (what is under test), a method and its controls. A design has a row for each run and date: y, and x in the
order of the run's terms. A prefix's moments, the sums of [1, x, y] and of its products, are window sums over the dates; fits at
any date, their cross-validation and their errors need moments only, at the few dates where a fit, a split or a window ends.
So a fold's fit is sent some small arrays, however long its history is, and all folds, placebo windows and final fits of all
runs are rows of one table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions import numeric
from quadrat.operators import validation

RUN = ["market", "method"]
SOLVERS = {"matched": "enet", "all": "lasso", "without_excluded": "lasso"}
FIT_SPLITS, FOLD_SPLITS = 5, 3
#: Coefficients of a smaller size don't select their control.
SELECTED = 1e-6
#: Shares of dates lost that warn and that count as an error.
LOSS_WARNS, LOSS_FAILS = 10, 20


def three_methods(panel: DataFrame, markets: DataFrame, matched: DataFrame, excluded: DataFrame) -> DataFrame:
    """market, method, region, k: the controls of each run, in order.

    markets: market (a region under test); matched: market, region; excluded: market, region. Matched controls, all regions but
    the market's, and those without excluded ones: the third only where an excluded region is in the panel. The last two need
    two controls.
    """
    others = markets.join(panel.select("region").distinct(), F.col("market") != F.col("region"))  # regions by markets, the candidates themselves
    out = excluded.join(others, ["market", "region"], "left_semi")
    left = others.join(out, ["market", "region"], "left_anti").join(out.select("market").distinct(), "market", "left_semi")
    enough = lambda df: df.withColumn("n", F.count("*").over(Window.partitionBy("market"))).where("n >= 2").drop("n")
    rows = matched.join(others, ["market", "region"], "left_semi").select("market", "region", F.lit("matched").alias("method"))
    rows = rows.unionByName(enough(others).withColumn("method", F.lit("all"))).unionByName(enough(left).withColumn("method", F.lit("without_excluded")))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*RUN).orderBy("region")))


def design(panel: DataFrame, runs: DataFrame, lags: list[int] = (), days: int = 7) -> DataFrame:
    """market, method, date, y, x: dates that have the market's value and every term; terms by (lag, control).

    A term of lag n is the control's value n periods before, by the calendar. n_before tells how many dates the run had with any
    value of the market or a control, i the row's number.
    """
    values = panel.where("kpi is not null").select("region", "date", F.lit(0).alias("lag"), F.col("kpi").alias("v"))
    if lags:
        values = values.unionByName(validation.calendar_lags(panel, list(lags), days).select("region", "date", "lag", F.col("kpi").alias("v")))
    per_run = runs.groupBy(*RUN).agg((F.count("*") * (1 + len(lags))).alias("n_terms"))
    own = runs.join(values, "region").groupBy(*RUN, "date").agg(F.array_sort(F.collect_list(F.struct("lag", "k", "v"))).alias("t"))
    tests = panel.select(F.col("region").alias("market"), "date", F.col("kpi").alias("y"))
    dates = runs.select(*RUN, "region").unionByName(runs.select(*RUN, F.col("market").alias("region")).distinct()).join(panel.select("region", "date"), "region")
    before = dates.groupBy(*RUN).agg(F.count_distinct("date").alias("n_before"))
    full = own.join(per_run, RUN).where(F.size("t") == F.col("n_terms")).join(tests.where("y is not null"), ["market", "date"]).join(before, RUN)
    order = Window.partitionBy(*RUN).orderBy("date")
    return full.select(*RUN, "date", "y", F.transform("t", lambda x: x["v"]).alias("x"), "n_before", (F.row_number().over(order) - 1).cast("int").alias("i"))


def term_labels(runs: DataFrame, lags: list[int] = (), frequency: str = "weekly") -> DataFrame:
    """market, method, terms: a struct (feature, region, term) for each place of x."""
    noun = {"weekly": "week", "daily": "day"}[frequency]
    label = F.when(F.col("lag") == 0, f"Same {noun}").otherwise(F.concat(F.lit("Lag "), F.col("lag").cast("string"), F.when(F.col("lag") == 1, f" {noun}").otherwise(f" {noun}s")))
    feature = F.when(F.col("lag") == 0, F.col("region")).otherwise(F.concat("region", F.lit("_lag"), F.col("lag").cast("string")))
    rows = runs.select("*", F.explode(F.array(*map(F.lit, [0, *lags]))).alias("lag"))
    packed = rows.groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct("lag", "k", feature.alias("feature"), "region", label.alias("term")))).alias("t"))
    return packed.select(*RUN, F.transform("t", lambda x: F.struct(x["feature"].alias("feature"), x["region"].alias("region"), x["term"].alias("term"))).alias("terms"))


def scaled(designs: DataFrame) -> DataFrame:
    """The designs with y and x less their means and over their deviations (means_x, scales_x, mean_y, scale_y), so that sums keep their digits."""
    places = designs.select(*RUN, F.posexplode("x").alias("j", "v")).groupBy(*RUN, "j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    per_x = places.groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct("j", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("p"))
    per_y = designs.groupBy(*RUN).agg(F.avg("y").alias("mean_y"), F.stddev_pop("y").alias("s"))
    own = designs.join(per_x.select(*RUN, F.transform("p", lambda q: q["m"]).alias("means_x"), F.transform("p", lambda q: q["s"]).alias("scales_x")), RUN)
    own = own.join(per_y.select(*RUN, "mean_y", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("scale_y")), RUN)
    z = F.transform("x", lambda v, j: (v - F.get("means_x", j)) / F.get("scales_x", j))
    return own.withColumn("zx", z).withColumn("zy", (F.col("y") - F.col("mean_y")) / F.col("scale_y"))


def products(y: Column, x: Column) -> Column:
    """The products of [1, x, y] with each other, row by row."""
    a = F.concat(F.array(F.lit(1.0)), x, F.array(y))
    return F.flatten(F.transform(a, lambda p: F.transform(a, lambda q: p * q)))


def prefix_moments(designs: DataFrame, ends: DataFrame, y: str = "y", x: str = "x") -> DataFrame:
    """market, method, at, moments: the sums of products of the first ``at`` rows, for the rows of ``ends`` (market, method, at).

    Sums of a row's segment (between neighbouring ends) come first, combined before the shuffle; windows then add few rows up.
    """
    marks = ends.select(*(F.col(c).alias(f"own_{c}") for c in RUN), "at").distinct()
    since = F.lag("at").over(Window.partitionBy("own_market", "own_method").orderBy("at"))
    segments = marks.withColumn("since", F.coalesce(since, F.lit(0)))
    rows = designs.join(segments, [*(F.col(c) == F.col(f"own_{c}") for c in RUN), F.col("i") >= F.col("since"), F.col("i") < F.col("at")])
    each = rows.select(*RUN, "at", F.posexplode(products(F.col(y), F.col(x))).alias("e", "v")).groupBy(*RUN, "at", "e").agg(F.sum("v").alias("v"))
    run_up = each.withColumn("v", F.sum("v").over(Window.partitionBy(*RUN, "e").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    return run_up.groupBy(*RUN, "at").agg(F.array_sort(F.collect_list(F.struct("e", "v"))).alias("m")).select(*RUN, "at", F.transform("m", lambda q: q["v"]).alias("moments"))


def windows(designs: DataFrame, kind: str, first: int, length: int, most: int, splits: int = FOLD_SPLITS) -> DataFrame:
    """market, method, kind, start, length, splits: windows of a run's dates, with a stride where there are more than ``most``."""
    n = designs.groupBy(*RUN).agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= first + length)
    count = F.col("n") - first - length + 1
    stride = F.greatest(F.floor(count / most), F.lit(1)).cast("int")
    starts = F.slice(F.sequence(F.lit(first), F.col("n") - length, stride), 1, most)
    return n.select(*RUN, F.explode(starts).alias("start")).select(*RUN, F.lit(kind).alias("kind"), "start", F.lit(length).alias("length"), F.lit(splits).alias("splits"))


def history(designs: DataFrame, pre_end, splits: int = FIT_SPLITS) -> DataFrame:
    """The window of a run's dates after ``pre_end``, before which its final fit ends."""
    per = designs.groupBy(*RUN).agg(F.count_if(F.col("date") <= F.lit(pre_end).cast("date")).cast("int").alias("start"), F.count("*").cast("int").alias("n"))
    return per.where("start > 0").select(*RUN, F.lit("final").alias("kind"), "start", (F.col("n") - F.col("start")).alias("length"), F.lit(splits).alias("splits"))


def needed_ends(tasks: DataFrame) -> DataFrame:
    """market, method, kind, start, length, splits, ends: where a task needs prefixes: its splits' ends, its start, and its window's end."""
    n = F.col("start")
    k = F.when(n >= 6, F.greatest(F.lit(2), F.least("splits", F.floor(n / 3).cast("int")))).otherwise(0)
    size = F.floor(n / (F.col("k") + 1)).cast("int")
    train = F.when(F.col("k") > 0, F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: n - (F.col("k") - j) * size)).otherwise(F.array().cast("array<int>"))
    return tasks.withColumn("k", k).withColumn("ends", F.concat(train, F.array(n))).drop("k")


_FIT = "market string, method string, kind string, start int, length int, used_cv boolean, alpha double, l1_ratio double, intercept double, coef array<double>"


def fits(designs: DataFrame, tasks: DataFrame, solvers: dict[str, str] | None = None) -> DataFrame:
    """market, method, kind, start, length, used_cv, alpha, l1_ratio, intercept, coef (in units of y and x) of every task.

    Each row of the table that is fitted holds one task's arrays; tasks of a run are spread by their hash.
    """
    solvers = SOLVERS if solvers is None else solvers
    own = scaled(designs)
    wanted = needed_ends(tasks)
    each = wanted.select(*RUN, "kind", "start", "length", F.explode("ends").alias("at"))
    sums = prefix_moments(own, each, "zy", "zx")
    units = own.groupBy(*RUN).agg(*(F.any_value(c).alias(c) for c in ("means_x", "scales_x", "mean_y", "scale_y")))
    packed = each.join(sums, [*RUN, "at"]).groupBy(*RUN, "kind", "start", "length").agg(F.array_sort(F.collect_list(F.struct("at", "moments"))).alias("m")).join(units, RUN)

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                size = len(r.means_x) + 2
                prefixes = [numeric.Moments(np.array(m["moments"]).reshape(size, size)) for m in r.m]
                fit = numeric.fit_moments(solvers[r.method], prefixes, unit=r.scale_y)
                coef = fit.coef / fit.scale * r.scale_y / r.scales_x  # of y and x as they are
                intercept = r.mean_y + fit.intercept * r.scale_y - float(fit.coef @ (fit.mean / fit.scale)) * r.scale_y - float(coef @ r.means_x)
                out.append((r.market, r.method, r.kind, r.start, r.length, fit.used_cv, fit.alpha, fit.l1_ratio, intercept, coef))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _FIT.split(", ")])

    parts = int(designs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(parts, *RUN, "kind", "start").mapInPandas(run, _FIT)  # by number: few bytes, but much work each


def predicted(intercept: Column, coef: Column, x: Column) -> Column:
    return intercept + F.aggregate(F.zip_with(coef, x, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def window_errors(designs: DataFrame, fitted: DataFrame, days: int = 7) -> DataFrame:
    """The fits of folds and placebo windows with the errors of their windows' predictions; windows with a gap in their dates are left out."""
    y, p = F.col("y"), F.col("p")
    keys = [*RUN, "kind", "start", "length"]
    rows = fitted.where("kind != 'final'").join(designs, RUN).where("i >= start and i < start + length").withColumn("p", predicted(F.col("intercept"), F.col("coef"), F.col("x")))
    e = rows.groupBy(*keys).agg(
        (F.avg(validation.smape_term(y, p)) * 100).alias("smape"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.avg(p - y).alias("bias"), F.avg(y).alias("mean_y"), F.sum(y - p).alias("uplift"), F.sum(p).alias("base"),
        F.date_diff(F.max("date"), F.min("date")).alias("span"), F.any_value("used_cv").alias("used_cv"),
    )
    whole = e.where(F.col("span") == (F.col("length") - 1) * days)
    return whole.select(*keys, "used_cv", "smape", "rmse", "bias", (F.try_divide("bias", "mean_y") * 100).alias("bias_pct"), "uplift", (F.try_divide("uplift", "base") * 100).alias("uplift_pct"))


def coefficient_table(runs: DataFrame, terms: DataFrame, deviations: DataFrame | None = None, selected: float = SELECTED) -> DataFrame:
    """market, method, feature, region, term, coefficient, selected, contribution, place: the terms by falling share of contribution.

    runs: market, method, coef; terms: market, method, terms (``term_labels``); deviations: market, method, devs, an array with each
    term's deviation. A contribution is |coef| times the deviation as a share of the run's sum; without deviations |coef| counts.
    """
    own = runs.select(*RUN, "coef").join(terms, RUN)
    own = own.join(deviations.select(*RUN, "devs"), RUN) if deviations is not None else own.withColumn("devs", F.transform("coef", lambda _: F.lit(1.0)))
    rows = own.select(*RUN, F.explode(F.arrays_zip("terms", "coef", "devs")).alias("q")).select(*RUN, "q.terms.feature", "q.terms.region", "q.terms.term", F.col("q.coef").alias("coefficient"), (F.abs("q.coef") * F.col("q.devs")).alias("size"))
    share = F.coalesce(F.try_divide("size", F.sum("size").over(Window.partitionBy(*RUN))), F.lit(0.0))
    rows = rows.withColumn("selected", F.abs("coefficient") > selected).withColumn("contribution", share)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*RUN).orderBy(F.desc("size"), "feature"))).drop("size")


def row_loss(before: Column, after: Column) -> Column:
    """error, warning or none, by the share of dates that a run loses for want of a value."""
    lost = (before - after) / before * 100
    return F.when(lost > LOSS_FAILS, "error").when(lost > LOSS_WARNS, "warning").otherwise("none")


def validation_run(designs: DataFrame, pre_end, terms: DataFrame, fold: tuple[int, int], placebo: tuple[int, int], days: int = 7, cut=lambda df: df) -> DataFrame:
    """A row for each run: errors before ``pre_end``, rolling folds, placebo windows, the uplift after, and the confidence that follows.

    fold and placebo: rows before the first window, and a window's length. ``cut`` may write the fits to a table, which several
    sums then read. The cross-validation's state is ``final`` (the final fit had none), ``folds`` (some fold hadn't) or ``all``.
    """
    tasks = windows(designs, "fold", *fold, validation.MAX_FOLDS).unionByName(windows(designs, "placebo", *placebo, validation.MAX_PLACEBOS)).unionByName(history(designs, pre_end))
    fitted = cut(fits(designs, tasks))
    errors = cut(window_errors(designs, fitted, days))
    final = fitted.where("kind = 'final'")
    rows = final.join(designs, RUN).withColumn("predicted", predicted(F.col("intercept"), F.col("coef"), F.col("x"))).withColumn("in_pre", F.col("i") < F.col("start")).withColumn("residual", F.col("y") - F.col("predicted"))
    rows = cut(rows.select(*RUN, "date", "y", "predicted", "residual", "in_pre"))
    pre = rows.where("in_pre")
    fit = validation.error_metrics(pre.withColumnRenamed("y", "actual"), RUN).withColumnRenamed("smape", "pre_smape")
    walk = validation.durbin_watson(pre.select(*RUN, "date", "residual"), RUN)
    up = rows.where("not in_pre").groupBy(*RUN).agg(F.sum("residual").alias("uplift"), (F.try_divide(F.sum("residual"), F.sum("predicted")) * 100).alias("uplift_pct"))
    folds = errors.where("kind = 'fold'").groupBy(*RUN).agg(
        F.count("*").alias("n_folds"), F.count_if(~F.col("used_cv")).alias("n_exploratory"), F.avg(F.when(F.col("used_cv"), F.col("smape"))).alias("rolling_smape"),
        F.percentile(F.when(F.col("used_cv"), F.col("smape")), F.lit(0.9)).alias("rolling_p90"), F.avg(F.when(F.col("used_cv"), F.col("bias_pct"))).alias("bias_pct"),
    )
    seen = errors.where("kind = 'placebo'").join(up.select(*RUN, F.col("uplift").alias("observed")), RUN, "left")
    centre = seen.withColumn("m", F.avg("uplift").over(Window.partitionBy(*RUN)))
    share = lambda c: F.avg(F.when(c, 1.0).when(F.col("observed").isNotNull(), 0.0))
    placebos = centre.groupBy(*RUN).agg(
        F.count("*").alias("n_placebos"), F.median("uplift").alias("placebo_median"), F.percentile("uplift", F.array(F.lit(0.025), F.lit(0.975))).alias("q"),
        share(F.col("uplift") >= F.col("observed")).alias("p_one_sided"), share(F.abs(F.col("uplift") - F.col("m")) >= F.abs(F.col("observed") - F.col("m"))).alias("p_two_sided"),
    ).select("*", F.get("q", 0).alias("placebo_lower"), F.get("q", 1).alias("placebo_upper")).drop("q")
    chosen = coefficient_table(final, terms).groupBy(*RUN).agg(F.count_distinct("region").alias("n_controls"), F.count_distinct(F.when(F.col("selected"), F.col("region"))).alias("n_selected"), F.count_if("selected").alias("n_selected_terms"))
    size = designs.groupBy(*RUN).agg(F.count("*").alias("n_dates"), F.max("n_before").alias("n_before"))
    out = fit.join(walk, RUN).join(final.select(*RUN, "used_cv", "alpha", "l1_ratio"), RUN).join(size, RUN).join(chosen, RUN)
    for part in (folds, placebos, up):
        out = out.join(part, RUN, "left")
    state = F.when(~F.col("used_cv"), "final").when(F.coalesce("n_exploratory", F.lit(0)) > 0, "folds").otherwise("all")
    rated = validation.bands(out).withColumn("confidence", F.when(F.col("used_cv"), F.col("confidence")).otherwise("insufficient"))  # a fit of a stated penalty isn't rated
    return rated.withColumn("cv_state", state).withColumn("row_loss", row_loss(F.col("n_before"), F.col("n_dates")))
