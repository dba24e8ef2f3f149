"""Decision rules: media delivery, plausibility of effects, recommendation of a design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses that pass a gate.
PASS = ("pass", "supported", "credible", "valid", "complete")


def derive_delivery(plans: DataFrame) -> DataFrame:
    """Fills what follows from what is given: budget from weekly amounts, impressions, reach, frequency and reach percentage.

    plans: plan_id, total_budget, weekly (map to amounts), cpm, impressions, frequency, reach, reach_percentage, eligible_audience.
    A derivation divides by positive numbers only; a weekly amount that is negative or missing voids the pattern.
    """
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    amounts = F.map_values("weekly")
    sound = (F.size(amounts) > 0) & F.forall(amounts, lambda x: x.isNotNull() & (x >= 0))
    x = plans.withColumn("total_budget", F.coalesce("total_budget", F.when(sound, F.aggregate(amounts, F.lit(0.0), lambda a, v: a + v))))
    x = x.withColumn("impressions", F.coalesce("impressions", F.col("total_budget") / positive("cpm") * 1000))
    x = x.withColumn("reach", F.coalesce("reach", F.col("impressions") / positive("frequency")))
    x = x.withColumn("frequency", F.coalesce("frequency", F.col("impressions") / positive("reach")))
    return x.withColumn("reach_percentage", F.coalesce("reach_percentage", F.col("reach") / positive("eligible_audience") * 100))


def assess_delivery(plans: DataFrame, min_impressions: float | None = None, min_reach: float | None = None, min_reach_percentage: float | None = None) -> DataFrame:
    """The derived plans with failed, missing, blockers and status."""
    x = derive_delivery(plans)
    limits = {"impressions": min_impressions, "reach": min_reach, "reach_percentage": min_reach_percentage}
    failed = F.array_compact(F.array(*(F.when(F.col(k) < float(v), F.lit(k)) for k, v in limits.items() if v is not None), F.lit(None).cast("string")))
    gone = lambda c: F.coalesce(F.col(c), F.lit(0.0)) == 0
    missing = F.array_compact(F.array(F.when(gone("impressions"), "impressions"), *(F.when(gone(k), F.lit(k)) for k in ("reach", "reach_percentage") if limits[k] is not None)))
    broken = F.array_compact(F.array(F.when(F.col("reach_percentage") > 100, "reach_percentage"), F.when(F.col("frequency") <= 0, "frequency")))
    x = x.withColumn("failed", failed).withColumn("missing", missing).withColumn("broken", broken)
    status = F.when(F.size("failed") > 0, "not_feasible").when(F.size("broken") > 0, "blocked").when(F.size("missing") > 0, "incomplete").otherwise("feasible")
    return x.withColumn("status", status)


def weekly_preset(total: float, weeks: int, shape: str) -> Column:
    """An array of weekly amounts that sum to the total in cents: even, front or back loaded; the last takes the rounding."""
    weight = {"even": [1] * weeks, "front": list(range(weeks, 0, -1)), "back": list(range(1, weeks + 1))}[shape]
    s = sum(weight)
    parts = [round(total * w / s, 2) for w in weight[:-1]]
    return F.array(*map(F.lit, [*parts, round(total - sum(parts), 2)]))


def effect_distance(effect: Column, direction: Column) -> Column:
    return F.when(direction == "one_sided_positive", effect).when(direction == "one_sided_negative", -effect).otherwise(F.abs(effect))


def assess_effects(evidence: DataFrame) -> DataFrame:
    """A row for each scenario: whether it meets the minimum detectable effect, by how much, and the status of its evidence.

    evidence: case_id, evidence_type, quality, adjusted, central_approved, mde_pct, direction, scenarios (map of label to uplift).
    """
    s = F.when(F.col("adjusted") & ~F.col("central_approved"), "blocked").when((F.col("evidence_type") == "analyst_assumption") | (F.col("quality") == "unknown"), "conditional").otherwise("evidence_backed")
    x = evidence.select("case_id", "mde_pct", "direction", s.alias("status"), F.explode("scenarios").alias("label", "uplift_pct"))
    d = effect_distance(F.col("uplift_pct"), F.col("direction"))
    return x.select("case_id", "label", "uplift_pct", "status", (d >= F.col("mde_pct")).alias("meets_mde"), (d - F.col("mde_pct")).alias("margin_pct"))


def assess_designs(designs: DataFrame, least_cost: bool = False) -> DataFrame:
    """Each design with limiting (what stands against it), qualifies and conditional.

    designs: position, scenario_id, size_metric, duration_periods, cost, match_status, counterfactual_status, power_status,
    delivery_status, effect_status, region_constraints_status, power_usable, power_meets_target, effect_meets_mde.
    """
    st = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    ok = lambda c: st(c).isin(*PASS)
    eff = st(F.col("effect_status"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    tests = [
        (~ok(F.col("match_status")), "match quality"), (~ok(F.col("counterfactual_status")), "counterfactual validation"), (~ok(F.col("power_status")), "power status"),
        (~yes("power_usable"), "power not usable"), (~yes("power_meets_target"), "power below target"), (st(F.col("delivery_status")) != "feasible", "media delivery"),
        (~((eff == "evidence_backed") | ((eff == "conditional") & yes("effect_meets_mde"))), "effect plausibility"), (~yes("effect_meets_mde"), "effect below mde"),
        (~ok(F.col("region_constraints_status")), "region constraints"), (F.col("duration_periods") <= 0, "duration"),
    ]
    if least_cost:
        tests.append((F.col("cost").isNull(), "cost"))
    limiting = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in tests)))
    x = designs.withColumn("limiting", limiting)
    clean = F.size("limiting") == 0
    return x.withColumn("qualifies", clean & (eff == "evidence_backed")).withColumn("conditional", clean & (eff == "conditional"))


def recommend(assessed: DataFrame, least_cost: bool = False) -> DataFrame:
    """One row: the best design (a qualifying one before a conditional one), its state, and how many qualify.

    Smallest size, then duration, then cost; or cost first. The earlier design wins ties.
    """
    cost = F.coalesce("cost", F.lit(float("inf")))
    key = [cost, F.col("size_metric"), F.col("duration_periods")] if least_cost else [F.col("size_metric"), F.col("duration_periods"), cost]
    rank = F.struct(F.when(F.col("qualifies"), 0).otherwise(1).alias("a"), *(k.cast("double").alias(f"k{n}") for n, k in enumerate(key)), F.col("position").alias("p"))
    best = assessed.agg(F.min_by(F.when(F.col("qualifies") | F.col("conditional"), F.struct("scenario_id", "qualifies")), F.when(F.col("qualifies") | F.col("conditional"), rank)).alias("x"), F.count_if("qualifies").alias("n_qualifying"), F.count_if("conditional").alias("n_conditional"))
    state = F.when(F.col("x").isNull(), "no_qualifying_design").when(F.col("x.qualifies"), "recommended").otherwise("conditional")
    return best.select(F.col("x.scenario_id").alias("scenario_id"), state.alias("status"), "n_qualifying", "n_conditional")


def plan_errors(values: DataFrame, fields: DataFrame) -> DataFrame:
    """plan_id and error of every value that its profile doesn't allow.

    values: plan_id, profile_id, field, kind (numeric, text, date, list, mapping), number, text; fields: the catalogue.
    """
    f = fields.select(F.col("profile_id").alias("p"), F.col("field").alias("f"), "value_type")
    x = values.join(F.broadcast(f), (F.col("profile_id") == F.col("p")) & (F.col("field") == F.col("f")), "left")  # the catalogue is fixed
    wrong = F.col("kind") != F.col("value_type")
    number = F.col("number")
    error = (
        F.when(F.col("f").isNull(), F.concat(F.lit("unknown field "), "field"))
        .when((F.col("value_type") == "date") & (F.col("kind") == "text"), F.when(F.substring("text", 1, 10).try_cast("date").isNull(), F.concat("field", F.lit(" must be a valid ISO date"))))
        .when(wrong, F.concat("field", F.lit(" must be "), "value_type"))
        .when((F.col("kind") == "numeric") & (F.isnan(number) | (F.abs(number) == float("inf"))), F.concat("field", F.lit(" must be finite")))
        .when((F.col("kind") == "numeric") & (number < 0), F.concat("field", F.lit(" must be non-negative")))
    )
    return x.select("plan_id", error.alias("error")).where("error is not null")


def constraint_status(candidates: DataFrame) -> DataFrame:
    """pass or blocked, of arrays tests, controls, force_test, force_control, exclude_both, test_exclude and control_exclude."""
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    apart = lambda a, b: F.size(F.array_intersect(a, b)) == 0
    both = F.array_union("tests", "controls")
    ok = within("force_test", "tests") & within("force_control", "controls") & apart("exclude_both", both) & apart("test_exclude", "tests") & apart("control_exclude", "controls") & apart("tests", "controls")
    return candidates.withColumn("status", F.when(ok, "pass").otherwise("blocked"))


def candidate_state(candidates: DataFrame, target: float) -> DataFrame:
    """usable and blockers of candidates: passes_quality, power_completed, power_usable, power (null if it wasn't run)."""
    run = F.col("power").isNotNull()
    reasons = F.array_compact(F.array(F.when(~F.col("passes_quality"), "quality does not pass"), F.when(~run, "power was not run"), F.when(run & ~F.col("power_completed"), "power is incomplete"), F.when(run & ~F.col("power_usable"), "power is not usable"), F.when(run & (F.isnan("power") | (F.col("power") < target)), "power is below target")))
    return candidates.withColumn("blockers", reasons).withColumn("usable", F.size("blockers") == 0)
