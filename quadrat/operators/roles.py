"""Market sizes and roles of regions: weights that cover a panel, roles that contradict, controls that remain, balance of a choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the roles that a region may be given.
ROLES = ("exclude_from_both", "force_test_include", "test_only_exclude", "force_control_include", "control_only_exclude")
#: Roles that forbid a place in a group.
FORBIDDEN = {"test": ("exclude_from_both", "test_only_exclude", "force_control_include"), "control": ("exclude_from_both", "control_only_exclude")}
#: Roles that demand a place in a group.
DEMANDED = {"test": "force_test_include", "control": "force_control_include"}
#: Limits of the mean absolute standardised difference.
GOOD, HIGH = 0.20, 0.50


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def market_weights(panel: DataFrame, until: Column | None = None) -> DataFrame:
    """region, weight: a region's KPI up to a date, null where it has no value."""
    own = panel if until is None else panel.withColumn("kpi", F.when(F.col("date") <= until, F.col("kpi")))
    return own.groupBy("region").agg(F.sum(F.col("kpi").cast("decimal(38,6)")).cast("double").alias("weight"))


def weight_problems(weights: DataFrame, panel: DataFrame) -> DataFrame:
    """region, problem: regions without a weight (missing), weights of no region (unknown), and weights that are not finite
    and above 0 (not_positive). Weights fit a panel only if there is no row. An empty panel leaves unknown weights."""
    own = panel.select(F.col("region").alias("known")).distinct()
    w = weights.select(F.col("region").alias("given"), F.col("weight").cast("double").alias("weight"))
    both = own.join(w, F.col("known") == F.col("given"), "full")
    problem = F.when(F.col("given").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(~finite(F.col("weight")) | (F.col("weight") <= 0), "not_positive")
    return both.select(F.coalesce("known", "given").alias("region"), problem.alias("problem")).where("problem is not null").distinct()


def control_regions(regions: DataFrame, test: DataFrame, roles: DataFrame) -> DataFrame:
    """region: what may serve as control, neither in the test group nor kept from control nor meant for the test."""
    barred = roles.where(F.col("field").isin("exclude_from_both", "control_only_exclude", "force_test_include"))
    return regions.select("region").distinct().join(test.select("region").union(barred.select("region")).distinct(), "region", "left_anti")


def role_problems(regions: DataFrame, roles: DataFrame, groups: DataFrame) -> DataFrame:
    """region, problem: what forbids the groups (region, side: test or control) under the roles (region, field).

    unknown_role and unknown_<side>: no such region; in_both_groups; <side>_<role>: a role that forbids the place;
    without_<role>: a role that demands a place which the region hasn't; no_control (region null): no control is left.
    """
    known, r, g = regions.select("region").distinct(), roles.select("region", "field").distinct(), groups.select("region", "side").distinct()
    met = g.join(r, "region")
    found = [
        r.join(known, "region", "left_anti").select("region", F.lit("unknown_role").alias("problem")),
        g.join(known, "region", "left_anti").select("region", F.concat(F.lit("unknown_"), "side").alias("problem")),
        g.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region", F.lit("in_both_groups").alias("problem")),
    ]
    for side, fields in FORBIDDEN.items():
        found.append(met.where((F.col("side") == side) & F.col("field").isin(*fields)).select("region", F.concat("side", F.lit("_"), "field").alias("problem")))
    for side, field in DEMANDED.items():
        asked = r.where(F.col("field") == field)
        found.append(asked.join(g.where(F.col("side") == side), "region", "left_anti").select("region", F.concat(F.lit("without_"), "field").alias("problem")))
    found.append(g.agg(F.count_if(F.col("side") == "control").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("region"), F.lit("no_control").alias("problem")))
    return reduce(DataFrame.unionByName, found).distinct()


def selection_status(mean: Column, smds: Column, good: float = GOOD, high: float = HIGH) -> Column:
    """status, reason of a choice of controls, by the mean and the list of standardised differences of its features.

    A mean that isn't finite fails, unless there are features and none of them varies: then the choice stands on its distance.
    """
    some = F.coalesce(F.size(smds) > 0, F.lit(False)) & ~F.coalesce(F.exists(smds, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))
    say = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))
    return F.when(~finite(mean), F.when(some, say("supported", "no feature varies")).otherwise(say("fail", "not finite"))).when(mean <= good, say("pass", None)).when(mean <= high, say("supported", "above good")).otherwise(say("fail", "above high"))


def ordered_balance(balance: DataFrame) -> DataFrame:
    """The balance table, largest absolute standardised difference first, features without one last; ties by name."""
    return balance.orderBy(F.desc_nulls_last("abs_smd"), "feature")


def fallback_messages(folds: DataFrame) -> DataFrame:
    """method, message, n_fallback, n_folds of folds (method, fallback, main_fallback), for methods whose penalty could not be cross-validated.

    main: the whole fit couldn't, which says all; folds: some of its rolling-origin folds couldn't.
    """
    n = folds.groupBy("method").agg(F.count("fallback").alias("n_folds"), F.count_if("fallback").alias("n_fallback"), F.coalesce(F.bool_or("main_fallback"), F.lit(False)).alias("main"))
    return n.where("main or n_fallback > 0").select("method", F.when(F.col("main"), "main").otherwise("folds").alias("message"), "n_fallback", "n_folds")


def delivery_cost(budget: Column, current: Column) -> Column:
    """The total budget of a media delivery that is up to date, if it is a finite number."""
    x = budget.try_cast("double")
    return F.when(current & finite(x), x)
