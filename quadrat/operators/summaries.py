"""Summaries of many experiments from their tables: results by stage, what a decision needs, and what an audit needs.

Inputs are tables with a row for each result, frozen version, recommendation, source or stage. Each summary is one row an
experiment, combined before its shuffle. Frozen versions that repeat a number count once, the one of the greatest fingerprint;
nulls in a version's number are no version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of these stages only the named results are kept; of other stages all are.
KEPT = {
    "counterfactual_validation": ("corr", "r2", "smape", "n_selected", "rolling_smape_mean", "counterfactual_reliability"),
    "observed_impact": ("mean_uplift", "uplift_pct", "prob_pos", "uplift_pi_lower", "uplift_pi_upper", "corr", "r2", "smape"),
}
#: States of approval.
FROZEN, RECOMMENDED, PLANNING = "approved_design_frozen", "recommendation_available", "planning_in_progress"
#: What each state asks for next.
NEXT = {FROZEN: "check the frozen design, then launch or evaluate", RECOMMENDED: "decide on the recommendation, then freeze the design", PLANNING: "finish the open planning stages"}


def is_kept(stage: Column, name: Column) -> Column:
    rule = F.lit(True)
    for s, names in KEPT.items():
        rule = F.when(stage == s, name.isin(*names)).otherwise(rule)
    return rule


def result_summaries(results: DataFrame) -> DataFrame:
    """experiment, stage, method, values (map from name to value). results: experiment, stage, method, name, value (string).

    A stage without methods has a null method. Of repeated names the greatest value counts; a null value stays as null.
    """
    own = results.where(is_kept(F.col("stage"), F.col("name")) & F.col("name").isNotNull())
    one = own.groupBy("experiment", "stage", "method", "name").agg(F.max("value").alias("value"))
    return one.groupBy("experiment", "stage", "method").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("values"))


def frozen_versions(versions: DataFrame) -> DataFrame:
    """experiment, version, frozen_at, fingerprint: each number once."""
    return versions.where("version is not null").groupBy("experiment", "version").agg(F.max_by("frozen_at", "fingerprint").alias("frozen_at"), F.max("fingerprint").alias("fingerprint"))


def stakeholder_summaries(experiments: DataFrame, versions: DataFrame, recommendations: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each experiment: state of approval, active frozen version, the recommendation, its source, and what comes next.

    recommendations: experiment, status, scenario, limiting (array), overridden; sources: experiment, embedded, status; a row an
    experiment at most. What isn't there is ``not_supplied``, ``not_recorded``, no limiting factor and no override.
    """
    active = versions.where("version is not null").groupBy("experiment").agg(F.max("version").alias("active_version"))
    rec = recommendations.select("experiment", F.lit(True).alias("recommended"), F.col("status").alias("rec_status"), "scenario", "limiting", "overridden")
    src = sources.select("experiment", "embedded", F.col("status").alias("source_status"))
    own = experiments.select("experiment").distinct()
    for part in (active, rec, src):
        own = own.join(part, "experiment", "left")
    state = F.when(F.col("active_version").isNotNull(), FROZEN).when(F.col("recommended"), RECOMMENDED).otherwise(PLANNING)
    return own.withColumn("approval", state).select(
        "experiment", "approval", "active_version", F.coalesce(F.nullif("rec_status", F.lit("")), F.lit("not_supplied")).alias("recommendation"), F.col("scenario").alias("selected_scenario"),
        F.coalesce("limiting", F.array().cast("array<string>")).alias("limiting_factors"), F.coalesce("overridden", F.lit(False)).alias("override_applied"),
        F.coalesce("embedded", F.lit(False)).alias("source_embedded"), F.coalesce("source_status", F.lit("not_recorded")).alias("source_status"),
        F.coalesce(*(F.when(F.col("approval") == k, v) for k, v in NEXT.items())).alias("next_action"),
    )


def technical_summaries(stages: DataFrame, versions: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each experiment with stages: their states (array by stage), stale ones, frozen versions in order, stages with results.

    stages: experiment, stage, status, stale, fingerprint.
    """
    state = stages.groupBy("experiment").agg(
        F.array_sort(F.collect_list(F.struct("stage", "status", "stale", "fingerprint"))).alias("stages"), F.array_sort(F.collect_set(F.when(F.col("stale"), F.col("stage")))).alias("stale_stages")
    )
    frozen = frozen_versions(versions).groupBy("experiment").agg(F.array_sort(F.collect_list(F.struct("version", "frozen_at", "fingerprint"))).alias("frozen_versions"))
    seen = results.groupBy("experiment").agg(F.array_sort(F.collect_set("stage")).alias("result_stages"))
    own = state.join(frozen, "experiment", "left").join(seen, "experiment", "left")
    none = F.col("frozen_versions").isNull()
    return own.withColumn("active_version", F.when(~none, F.element_at("frozen_versions", -1))).withColumn("frozen_versions", F.when(none, F.array().cast(own.schema["frozen_versions"].dataType)).otherwise(F.col("frozen_versions"))).withColumn("result_stages", F.coalesce("result_stages", F.array().cast("array<string>")))
