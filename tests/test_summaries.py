"""Summaries of experiments and rates of methods: absent parts, repeated rows, nulls and empty tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from quadrat.operators import evidence, matching, summaries

DAY = datetime.date(2024, 1, 1)
RUN = "scenario string, method string, fit string, completed boolean, n_blockers int, error string, fallback string, power_zero double, power double, reference double, mde double, reference_mde double, mde_reached boolean, reference_reached boolean, seconds double"


@pytest.fixture(scope="module")
def parts(spark):
    versions = spark.createDataFrame([(1, 1, DAY, "a"), (1, 3, DAY, "b"), (1, 3, None, "c"), (2, None, DAY, "d")], "experiment int, version int, frozen_at date, fingerprint string")
    rec = spark.createDataFrame([(1, "ok", "s1", ["cost"], True), (2, "", None, None, None)], "experiment int, status string, scenario string, limiting array<string>, overridden boolean")
    src = spark.createDataFrame([(2, True, None)], "experiment int, embedded boolean, status string")
    results = spark.createDataFrame([(1, "observed_impact", None, n, v) for n, v in (("r2", "0.5"), ("r2", "0.7"), ("trace", "x"), ("corr", None), (None, "1"))] + [(1, "power", "m", "trace", "x")], "experiment int, stage string, method string, name string, value string")
    return versions, rec, src, results


def test_stakeholder_summaries(spark, parts):
    versions, rec, src, _ = parts
    own = spark.createDataFrame([(k,) for k in (1, 2, 3, 3, None)], "experiment int")
    got = {r["experiment"]: r for r in summaries.stakeholder_summaries(own, versions, rec, src).collect()}
    assert len(got) == 4
    assert tuple(got[1])[1:9] == (summaries.FROZEN, 3, "ok", "s1", ["cost"], True, False, "not_recorded")
    assert tuple(got[2])[1:9] == (summaries.RECOMMENDED, None, "not_supplied", None, [], False, True, "not_recorded")
    for k in (3, None):
        assert tuple(got[k])[1:9] == (summaries.PLANNING, None, "not_supplied", None, [], False, False, "not_recorded")
    assert all(r["next_action"] == summaries.NEXT[r["approval"]] for r in got.values())
    assert summaries.stakeholder_summaries(own.limit(0), versions, rec, src).count() == 0


def test_technical_summaries(spark, parts):
    versions, _, _, results = parts
    stages = spark.createDataFrame([(1, "power", "completed", True, "p"), (1, "match", "completed", False, None), (3, "match", None, None, None)], "experiment int, stage string, status string, stale boolean, fingerprint string")
    got = {r["experiment"]: r for r in summaries.technical_summaries(stages, versions, results).collect()}
    assert [s["stage"] for s in got[1]["stages"]] == ["match", "power"] and got[1]["stale_stages"] == ["power"]
    assert [tuple(v) for v in got[1]["frozen_versions"]] == [(1, DAY, "a"), (3, None, "c")] and got[1]["active_version"]["version"] == 3
    assert got[1]["result_stages"] == ["observed_impact", "power"]
    assert (got[3]["stale_stages"], got[3]["frozen_versions"], got[3]["active_version"], got[3]["result_stages"]) == ([], [], None, [])


def test_result_summaries(parts):
    got = {(r["stage"], r["method"]): r["values"] for r in summaries.result_summaries(parts[3]).collect()}
    assert got == {("observed_impact", None): {"corr": None, "r2": "0.7"}, ("power", "m"): {"trace": "x"}}
    assert summaries.result_summaries(parts[3].limit(0)).count() == 0


def test_method_rates(spark):
    rows = [
        ("noisy", "m", "ols", True, 0, None, "", 0.07, 0.9, 0.8, 2.0, 1.0, True, True, 1.0),
        ("noisy", "m", "ols", False, 2, None, None, None, None, 0.8, None, 1.0, None, True, 2.0),
        ("plain", "m", "ols", False, 1, None, "ridge", None, None, 0.8, None, 1.0, None, True, 3.0),
        ("plain", "m", "ols", False, 0, "failed", None, None, None, 0.8, None, 1.0, None, True, None),
        ("plain", "m", "ols", True, 0, "", None, 0.05, 0.5, float("nan"), 3.0, None, True, False, float("inf")),
        ("plain", "m", "ols", True, 0, None, None, 0.05, 0.7, 0.7, None, 0.0, None, None, 4.0),
        ("other", "m", None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    runs = spark.createDataFrame(rows, RUN)
    expected = spark.createDataFrame([("noisy", True), ("plain", False)], "scenario string, blocked boolean")
    got = {r["scenario"] if r["level"] == 0 else "all": r for r in evidence.method_rates(runs, expected).collect()}
    total = got["all"]
    assert (total["n_runs"], total["n_completed"], total["n_failed"], total["n_incomplete"], total["n_blocked"], total["n_fallback"]) == (7, 3, 1, 3, 2, 1)
    assert (total["n_false_supported"], total["false_supported_rate"], total["n_false_blocked"], total["false_blocked_rate"]) == (1, 0.5, 1, 0.25)
    assert (total["n_false_mde"], total["false_mde_rate"], total["mde_error_n"], total["mde_error_mean"]) == (1, 0.5, 1, 1.0)
    assert total["power_bias_n"] == 2 and total["power_error_mean"] == pytest.approx(0.05) and total["seconds_n"] == 4
    assert total["power_sd_n"] == 1 and total["power_sd_p50"] == pytest.approx(0.2 / 2**0.5)
    assert got["noisy"]["power_sd_n"] is None and got["noisy"]["false_blocked_rate"] is None and got["other"]["false_supported_rate"] is None and got["other"]["n_incomplete"] == 1
    assert evidence.method_rates(runs.where(F.lit(False)), expected).count() == 0


def test_match_results(spark):
    """Ties, a feature without spread, members that aren't there, a strategy without any, and the order of groups."""
    regions = {"t": (10.0, 1.0, 5.0), "a": (1.0, 2.0, 5.0), "b": (3.0, 2.0, 5.0), "c": (2.0, 5.0, 5.0), "d": (0.0, 4.0, 5.0)}
    long = spark.createDataFrame([(r, p, f, v) for r, (p, x, y) in regions.items() for f, v in (("x", x), ("flat", y))], "region string, population double, feature string, value double")
    tried = [("s", 1, "g1", "c"), ("s", 2, "g2", "d"), ("s", 3, "g3", "a"), ("s", 4, "g0", "b"), ("s", 4, "g0", "nowhere"), ("s", 5, "g5", "c"), ("s", 5, "g5", "a"), ("s", 5, "g5", "a"), ("gone", 1, "g", "nowhere")]
    members = spark.createDataFrame(tried, "strategy string, place int, group_id string, region string")
    (got,) = matching.match_results(members, long, spark.createDataFrame([("t",)], "region string"), seed=7).collect()
    sd = 1.4696938456699067  # of 1, 2, 2, 5 and 4
    assert (got["strategy"], got["controls"], got["candidates"], got["seed"]) == ("s", ["b"], 5, 7)
    assert got["convergence"] == pytest.approx([4 / sd, 3 / sd, 1 / sd]) and got["distance"] == pytest.approx(1 / sd) == got["mean_abs_smd"]
    assert [(s["feature"], s["abs_smd"] and round(s["abs_smd"], 9)) for s in got["smds"]] == [("flat", None), ("x", round(1 / sd, 9))]
    assert matching.match_results(members.limit(0), long, members.select("region").limit(0)).count() == 0
