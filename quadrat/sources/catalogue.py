"""Platform profiles: which fields a media plan may have, and of what type. Fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIELDS = (
    ("total_budget", "numeric", "currency"), ("weekly_budget_pattern", "mapping", None), ("cpm", "numeric", "currency per 1,000 impressions"), ("impressions", "numeric", "impressions"),
    ("reach", "numeric", "people or accounts"), ("reach_percentage", "numeric", "%"), ("frequency", "numeric", "average exposures"), ("eligible_audience", "numeric", "people or accounts"),
    ("campaign_objective", "text", None), ("optimisation_event", "text", None), ("targeting_restrictions", "list", None), ("geographic_targeting_method", "text", None),
    ("existing_activity_in_control", "text", None), ("spillover_contamination", "text", None), ("forecast_source", "text", None), ("forecast_date", "date", None),
)
PROFILES = {"meta_auction_social": FIELDS}


def profile_fields(spark: SparkSession) -> DataFrame:
    """profile_id, field, value_type, unit, required of every profile."""
    return spark.createDataFrame([(p, k, t, u, False) for p, fs in sorted(PROFILES.items()) for k, t, u in fs], "profile_id string, field string, value_type string, unit string, required boolean")


def profile(profile_id: str) -> tuple:
    if profile_id not in PROFILES:
        raise ValueError(f"unknown platform profile {profile_id!r}; known are {', '.join(sorted(PROFILES))}")
    return PROFILES[profile_id]
