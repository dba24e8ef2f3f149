"""The power contract: plans checked by rule, safety gates by market, and minimum detectable effects by bisection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators import power

#: Fixed values of the safety policy.
SUPPORTED_FREQUENCIES = {"weekly": 7}
KNOWN_FREQUENCIES = {"weekly": 7, "daily": 1}
HISTORY_FLOOR = {"weekly": 104}
PERIODS_PER_PREDICTOR = 10
SCALE_P, SCALE_CORRELATION = 0.05, 0.15
BLOCK, RESAMPLES, SEED = 13, 199, 20260713
LEAST_RESIDUALS = 8
#: A constant or repeated control is told by this share of its size, and this much beside it.
SAME_SHARE, SAME_AMOUNT = 1e-5, 1e-8


# the smallest detectable effect

def detected(alternatives: Column, base: Column, lower: Column, upper: Column, effect: Column, sign: int) -> Column:
    """The share of alternative totals, moved by an effect in percent of the base, that lie beyond the critical values."""
    moved = lambda t: t + sign * base * effect / 100
    beyond = lambda t: F.coalesce(moved(t) < lower, F.lit(False)) | F.coalesce(moved(t) > upper, F.lit(False))
    return F.try_divide(F.size(F.filter(alternatives, beyond)), F.size(alternatives))


def minimum_detectable(rows: DataFrame, bounds: tuple[float, float] = (0.0, 60.0), target: float = 0.8, tolerance: float = 0.01, points: int = 41, side: str = "one_sided_positive") -> DataFrame:
    """rows (alternatives, base, lower, upper, and keys) with mde_pct (null if no point reaches the target), reached, monotone and power.

    The first point of an even grid whose power reaches the target, then halves between it and the one before until they are
    ``tolerance`` apart: a fold over a stated number of steps. All effects move the same draws. Where power falls along the grid
    (monotone is false) the first crossing counts, as it does on the grid.
    """
    lo, hi = bounds
    if not (0 <= lo < hi and math.isfinite(hi) and 0 < target < 1 and tolerance > 0 and points > 1):
        raise ValueError("bounds from 0 and rising, a target within (0, 1), a tolerance above 0 and two points are needed")
    sign = -1 if side == "one_sided_negative" else 1
    share = lambda e: detected(F.col("alternatives"), F.col("base"), F.col("lower"), F.col("upper"), e, sign)
    grid = [lo + k * (hi - lo) / (points - 1) for k in range(points)]
    own = rows.withColumn("quadrat_p", F.transform(F.array(*map(F.lit, grid)), share))
    hit = F.array_position(F.transform("quadrat_p", lambda p: p >= target), True).cast("int")  # from 1; 0 if none
    own = own.withColumn("quadrat_k", hit)
    at = lambda k: F.lit(lo) + (k - 1) * F.lit((hi - lo) / (points - 1))
    start = F.struct(at(F.greatest(F.col("quadrat_k") - 1, F.lit(1))).alias("a"), at(F.col("quadrat_k")).alias("b"))
    steps = max(1, math.ceil(math.log2((hi - lo) / (points - 1) / tolerance)) + 1)

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["a"] + acc["b"]) / 2
        nearer = F.when(share(middle) >= target, F.struct(acc["a"].alias("a"), middle.alias("b"))).otherwise(F.struct(middle.alias("a"), acc["b"].alias("b")))
        return F.when(acc["b"] - acc["a"] > tolerance, nearer).otherwise(acc)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["b"]
    falls = F.exists(F.sequence(F.lit(1), F.lit(points - 1)), lambda k: F.get("quadrat_p", k) < F.get("quadrat_p", k - 1))
    out = own.withColumn("reached", F.col("quadrat_k") > 0).withColumn("mde_pct", F.when(F.col("reached"), found)).withColumn("monotone", ~F.coalesce(falls, F.lit(False)))
    return out.withColumn("power", F.when(F.col("reached"), share(F.col("mde_pct")))).drop("quadrat_p", "quadrat_k")


# safety gates

def frequency_gate(frequency: Column) -> Column:
    return F.when(frequency.isin(*SUPPORTED_FREQUENCIES), "supported").when(frequency.isin(*KNOWN_FREQUENCIES), "blocked").otherwise("unsupported")


def seasonality_gate(frequency: Column) -> Column:
    """Days carry a calendar that the residual model has no place for."""
    return F.when(frequency == "daily", "blocked").otherwise("supported")


def history_gate(series: DataFrame, predictors: DataFrame) -> DataFrame:
    """market, retained, contiguous, history: series (market, frequency, date), predictors (market, n_kept)."""
    s = series.groupBy("market", "frequency").agg(F.count_distinct("date").alias("retained"), F.date_diff(F.max("date"), F.min("date")).alias("span"))
    pick = lambda d: F.coalesce(*(F.when(F.col("frequency") == k, F.lit(v)) for k, v in d.items()), F.lit(None).cast("int"))
    x = s.join(predictors.select("market", "n_kept"), "market", "left").withColumn("contiguous", F.coalesce(F.col("span") == (F.col("retained") - 1) * pick(KNOWN_FREQUENCIES), F.lit(False)))
    few = (F.coalesce("n_kept", F.lit(0)) > 0) & (F.col("retained") < F.col("n_kept") * PERIODS_PER_PREDICTOR)
    gate = F.when(pick(HISTORY_FLOOR).isNull(), "unsupported").when(F.col("retained") < pick(HISTORY_FLOOR), "blocked").when(~F.col("contiguous") | few, "supported_with_warning").otherwise("supported")
    return x.select("market", "retained", "contiguous", gate.alias("history"))


def persistence_gate(residuals: DataFrame) -> DataFrame:
    """market, rho, rho_upper, persistence. residuals: market, date, residual."""
    p = power.ar1_parameters(residuals, ["market"])
    gate = F.when(F.col("n") <= 1, "unsupported").otherwise(power.persistence_status(F.coalesce("rho", F.lit(0.0)), F.coalesce("rho_upper", F.lit(0.0))))
    return p.select("market", "rho", "rho_upper", gate.alias("persistence"))


def scale_association(residuals: DataFrame, block: int = BLOCK, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """market, association, p_value: how squared residuals go with the level, against orders of whole blocks.

    A resample is rows: its blocks in the order of a hash, each residual at the place that its block then has. Residuals of a
    block stay together, so that their dependence does.
    """
    w = Window.partitionBy("market").orderBy("date")
    own = residuals.withColumn("i", F.row_number().over(w) - 1).withColumn("mean", F.avg("residual").over(Window.partitionBy("market"))).withColumn("square", F.pow(F.col("residual") - F.col("mean"), 2))
    own = own.withColumn("block", F.floor(F.col("i") / block))
    seen = own.groupBy("market").agg(F.coalesce(F.corr("level", "square"), F.lit(0.0)).alias("association"))
    blocks = own.groupBy("market", "block").agg(F.count("*").alias("size")).select("*", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample"))
    order = Window.partitionBy("market", "resample").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("resample").cast("string"), F.col("block").cast("string")).cast("binary"))).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    moved = own.select("market", "block", "i", "square").join(placed, ["market", "block"]).select("market", "resample", (F.col("start") + F.col("i") - F.col("block") * block).alias("i"), "square")
    null = moved.join(own.select("market", F.col("i").cast("long").alias("i"), "level"), ["market", "i"]).groupBy("market", "resample").agg(F.coalesce(F.abs(F.corr("level", "square")), F.lit(0.0)).alias("c"))
    as_far = null.join(seen, "market").groupBy("market").agg(F.count_if(F.col("c") >= F.abs("association") - 1e-12).alias("n"))
    return seen.join(as_far, "market").select("market", "association", ((1 + F.col("n")) / (resamples + 1)).alias("p_value"))


def heteroskedasticity_gate(residuals: DataFrame, **resampling) -> DataFrame:
    """market, ratio, association, p_value, heteroskedasticity. residuals: market, date, residual, level."""
    w = Window.partitionBy("market")
    r = residuals.withColumn("k", F.row_number().over(w.orderBy("level", "date"))).withColumn("n", F.count("*").over(w))
    half = F.floor(F.col("n") / 2)
    v = r.groupBy("market").agg(F.var_samp(F.when(F.col("k") <= half, F.col("residual"))).alias("low"), F.var_samp(F.when(F.col("k") > F.col("n") - half, F.col("residual"))).alias("high"), F.max("n").alias("n"))
    ratio = F.when(F.col("low") > 0, F.col("high") / F.col("low")).when(F.col("high") > 0, F.lit(float("inf"))).otherwise(1.0)
    x = v.withColumn("ratio", ratio).join(scale_association(residuals, **resampling), "market")
    split = (F.col("ratio") >= power.RATIO_BLOCK) | (F.col("ratio") <= 1 / power.RATIO_BLOCK)
    scale = (F.col("p_value") <= SCALE_P) & (F.abs("association") >= SCALE_CORRELATION)
    gate = F.when(F.col("n") < LEAST_RESIDUALS, "unsupported").when(split | scale, "blocked").otherwise("supported")
    return x.select("market", "ratio", "association", "p_value", gate.alias("heteroskedasticity"))


def removed_controls(controls: DataFrame) -> DataFrame:
    """market, region, reason: controls that are constant, or repeat an earlier one. controls: market, region, date, kpi."""
    near = lambda a, b: F.abs(a - b) <= SAME_AMOUNT + SAME_SHARE * F.abs(b)
    constant = controls.groupBy("market", "region").agg(F.min("kpi").alias("lo"), F.max("kpi").alias("hi")).where(near(F.col("lo"), F.col("hi"))).select("market", "region", F.lit("constant").alias("reason"))
    rest = controls.join(constant.select("market", "region"), ["market", "region"], "left_anti")
    later, earlier = rest.select("market", "region", "date", "kpi"), rest.select("market", F.col("region").alias("first"), "date", F.col("kpi").alias("v"))
    pairs = later.join(earlier, ["market", "date"]).where("first < region").groupBy("market", "region", "first").agg(F.bool_and(near(F.col("kpi"), F.col("v"))).alias("same")).where("same")
    return constant.unionByName(pairs.select("market", "region").distinct().withColumn("reason", F.lit("duplicate")))


def control_gate(controls: DataFrame, n_dates: DataFrame) -> DataFrame:
    """market, n_kept, removed, fallback, control_matrix. n_dates: market, n."""
    gone = removed_controls(controls)
    named = gone.groupBy("market").agg(F.count("*").alias("n_removed"), F.array_join(F.array_sort(F.collect_list(F.concat("region", F.lit(" ("), "reason", F.lit(")")))), ", ").alias("removed"))
    x = controls.groupBy("market").agg(F.count_distinct("region").alias("n_all")).join(named, "market", "left").join(n_dates, "market")
    kept = (F.col("n_all") - F.coalesce("n_removed", F.lit(0))).cast("int")
    fallback = F.when(kept == 0, "no_informative_controls").when(kept + 1 > F.col("n"), "underdetermined")
    gate = F.when(fallback.isNotNull() | F.col("removed").isNotNull(), "supported_with_warning").otherwise("supported")
    return x.select("market", kept.alias("n_kept"), F.coalesce("removed", F.lit("")).alias("removed"), fallback.alias("fallback"), gate.alias("control_matrix"))


GATES = ("frequency_gate", "history", "persistence", "seasonality", "heteroskedasticity", "control_matrix")


def safety(series: DataFrame, residuals: DataFrame, controls: DataFrame, **resampling) -> DataFrame:
    """A row for each market: six gates and the most severe of them.

    series: market, frequency, date; residuals: market, date, residual, level; controls: market, region, date, kpi. Of a market whose
    fit fell back to a mean, persistence and heteroskedasticity say nothing of the model and count as supported.
    """
    n = series.groupBy("market").agg(F.count_distinct("date").alias("n"))
    matrix = control_gate(controls, n)
    x = history_gate(series, matrix).join(series.select("market", "frequency").distinct(), "market").join(matrix, "market", "left")
    x = x.join(persistence_gate(residuals), "market", "left").join(heteroskedasticity_gate(residuals, **resampling), "market", "left")
    applies = F.col("fallback").isNull()
    for c in ("persistence", "heteroskedasticity"):
        x = x.withColumn(c, F.when(applies, F.coalesce(c, F.lit("unsupported"))).otherwise("supported"))
    x = x.withColumn("control_matrix", F.coalesce("control_matrix", F.lit("supported"))).withColumn("frequency_gate", frequency_gate(F.col("frequency"))).withColumn("seasonality", seasonality_gate(F.col("frequency")))
    return x.withColumn("overall", power.worst_status(*map(F.col, GATES)))


# the contract

PLAN = "plan_id string, frequency string, tests array<string>, controls array<string>, history_start date, history_end date, holdout array<date>, planned array<date>, duration int, alpha double, target_power double, lower double, upper double, tolerance double, effects array<double>, n_simulations int, min_periods int"


def config_fingerprint() -> Column:
    """A hash of all settings of a plan but its name."""
    text = lambda c, kind: F.array_join(F.col(c).cast("array<string>"), ",") if kind.startswith("array") else F.col(c).cast("string")
    return F.sha2(F.concat_ws("|", *(F.coalesce(text(*x.split(" ")), F.lit("")) for x in PLAN.split(", ")[1:])), 256)


def plan_blockers() -> Column:
    """What in a plan's own settings rules it out, as codes in alphabetical order."""
    days = F.coalesce(*(F.when(F.col("frequency") == k, F.lit(v)) for k, v in KNOWN_FREQUENCIES.items()), F.lit(None).cast("int"))
    steps = lambda c: F.forall(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda k: (F.size(c) < 2) | (F.date_diff(F.get(c, k), F.get(c, k - 1)) == days))
    repeats = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    unknown = days.isNull()
    rules = {
        "alpha_out_of_range": ~((F.col("alpha") > 0) & (F.col("alpha") < 1)),
        "bounds_not_rising": ~((F.col("lower") >= 0) & (F.col("upper") > F.col("lower"))),
        "effect_out_of_bounds": (F.size("effects") == 0) | F.exists("effects", lambda e: (e < F.col("lower")) | (e > F.col("upper"))),
        "effect_repeated": repeats("effects"),
        "history_reversed": F.col("history_start") > F.col("history_end"),
        "holdout_count": F.size("holdout") != F.col("duration"),
        "holdout_not_adjacent": (F.size("holdout") == 0) | (F.date_diff(F.get("holdout", 0), F.col("history_end")) != days),
        "holdout_with_gaps": ~steps("holdout"),
        "planned_before_holdout_ends": (F.size("planned") > 0) & (F.get("planned", 0) <= F.element_at("holdout", -1)),
        "planned_count": (F.size("planned") > 0) & (F.size("planned") != F.col("duration")),
        "planned_with_gaps": ~steps("planned"),
        "region_in_both_groups": F.arrays_overlap("tests", "controls"),
        "region_repeated": repeats("tests") | repeats("controls"),
        "regions_missing": (F.size("tests") == 0) | (F.size("controls") == 0),
        "target_out_of_range": ~((F.col("target_power") > 0) & (F.col("target_power") < 1)),
        "tolerance_not_positive": ~(F.col("tolerance") > 0),
        "unknown_frequency": unknown,
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())))


def power_contract(plans: DataFrame, panel: DataFrame) -> DataFrame:
    """plan_id, fingerprint, n_history, n_holdout, missing_holdout, blockers, shortfalls, status of every plan (``PLAN``).

    A date is complete when all the plan's regions have a value; holdout dates without that are found by an anti-join. Status is
    blocked (the settings rule the plan out), incomplete (the panel lacks history or holdout dates) or completed.
    """
    regions = plans.select("plan_id", F.explode(F.array_union("tests", "controls")).alias("region"))
    wanted = regions.groupBy("plan_id").agg(F.count("*").alias("n_regions"))
    have = regions.join(panel.where("kpi is not null").select("region", "date").distinct(), "region").groupBy("plan_id", "date").agg(F.count("*").alias("n"))
    full = have.join(wanted, "plan_id").where("n = n_regions").select("plan_id", "date")
    own = plans.select("plan_id", "history_start", "history_end")
    past = full.join(own, "plan_id").where("date between history_start and history_end").groupBy("plan_id").agg(F.count("*").alias("n_history"))
    held = plans.select("plan_id", F.explode("holdout").alias("date")).distinct()
    lacking = held.join(full, ["plan_id", "date"], "left_anti").groupBy("plan_id").agg(F.array_join(F.array_sort(F.collect_list(F.col("date").cast("string"))), ",").alias("missing_holdout"), F.count("*").alias("n_missing"))
    x = plans.withColumn("fingerprint", config_fingerprint()).withColumn("blockers", plan_blockers()).join(past, "plan_id", "left").join(lacking, "plan_id", "left").na.fill(0, ["n_history", "n_missing"])
    short = F.array_compact(F.array(F.when(F.col("n_history") < F.col("min_periods"), "history_short"), F.when(F.col("n_missing") > 0, "holdout_missing")))
    x = x.withColumn("shortfalls", short).withColumn("n_holdout", F.size(F.array_distinct("holdout")) - F.col("n_missing"))
    status = F.when(F.size("blockers") > 0, "blocked").when(F.size("shortfalls") > 0, "incomplete").otherwise("completed")
    return x.select("plan_id", "fingerprint", "n_history", "n_holdout", F.coalesce("missing_holdout", F.lit("")).alias("missing_holdout"), F.array_join("blockers", ",").alias("blockers"), F.array_join("shortfalls", ",").alias("shortfalls"), status.alias("status"))
