"""Bisection, gates, plans, convergence, records, workbooks and array scores beyond what their SQL twins reach."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import contract, lineage, matching, posterior
from quadrat.schemas import UnreadableWorkbook
from quadrat.sources import workbook

DRAWS = "key int, alternatives array<double>, base double, lower double, upper double"


def plain_mde(alt, base, upper, hi, target, fine):
    share = lambda e: np.mean(np.array(alt) + base * e / 100 > upper)
    return next((e for e in np.arange(0, hi + fine, fine) if share(e) >= target), None)


@pytest.mark.parametrize("target", [0.3, 0.8, 0.95])
def test_bisection_equals_a_fine_grid(spark, target):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(0, s, 200)], 1000.0, None, c) for k, (s, c) in enumerate([(50, 80.0), (5, 8.0), (300, 900.0), (10, -50.0), (1, 5000.0)])]
    got = {r["key"]: r for r in contract.minimum_detectable(spark.createDataFrame(rows, DRAWS), target=target, tolerance=0.01).collect()}
    for k, alt, base, _, upper in rows:
        want = plain_mde(alt, base, upper, 60, target, 0.001)
        assert got[k]["reached"] == (want is not None) and got[k]["monotone"]
        if want is None:
            assert got[k]["mde_pct"] is None and got[k]["power"] is None
        else:
            assert got[k]["power"] >= target and -0.002 <= got[k]["mde_pct"] - want <= 0.011


def test_power_that_falls_again(spark):
    """Two sides: the effect first leaves the lower tail and then reaches the upper one; the first crossing counts."""
    rows = [(0, [-50.0] * 9 + [0.0], 100.0, -40.0, 40.0), (1, [], 100.0, None, 1.0)]
    got = {r["key"]: r for r in contract.minimum_detectable(spark.createDataFrame(rows, DRAWS), side="two_sided").collect()}
    assert (got[0]["reached"], got[0]["monotone"], got[0]["mde_pct"]) == (True, False, 0.0)
    assert got[1]["reached"] is False or got[1]["mde_pct"] is None
    with pytest.raises(ValueError):
        contract.minimum_detectable(spark.createDataFrame(rows, DRAWS), (5.0, 5.0))


def series(market, n, f, step=7):
    return [(market, datetime.date(2020, 1, 6) + datetime.timedelta(days=step * k), float(f(k))) for k in range(n)]


def test_gates_reach_every_state(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(size=400)
    made = {"calm": (120, lambda k: noise[k]), "short": (50, lambda k: noise[k]), "drift": (120, lambda k: np.cumsum(noise)[k]), "swell": (120, lambda k: noise[k] * (1 + k)), "few": (6, lambda k: noise[k])}
    rows = [(m, d, v, float(j)) for m, (n, f) in made.items() for j, (_, d, v) in enumerate(series(m, n, f))]
    residuals = spark.createDataFrame(rows, "market string, date date, residual double, level double")
    own = residuals.select("market", F.lit("weekly").alias("frequency"), "date")
    controls = residuals.select("market", F.lit("c").alias("region"), "date", F.col("residual").alias("kpi"))
    only = controls.where("market = 'drift'").select("market", "region", "date", F.lit(3.0).alias("kpi")).unionByName(controls.where("market != 'drift'"))
    got = {r["market"]: r for r in contract.safety(own, residuals, only).collect()}
    assert {m: got[m]["history"] for m in made} == {"calm": "supported", "short": "blocked", "drift": "supported", "swell": "supported", "few": "blocked"}
    assert got["drift"]["fallback"] == "no_informative_controls" and got["drift"]["persistence"] == "supported" and got["drift"]["control_matrix"] == "supported_with_warning"
    again = {r["market"]: r for r in contract.safety(own, residuals, controls).collect()}
    assert again["drift"]["persistence"] == "blocked" and again["drift"]["overall"] == "blocked"
    assert got["swell"]["heteroskedasticity"] == "blocked" and got["calm"]["heteroskedasticity"] == "supported" and got["few"]["heteroskedasticity"] == "unsupported"
    assert got["calm"]["overall"] == "supported"
    gapped = own.where("market = 'calm' and date != DATE '2020-03-02'")
    assert contract.safety(gapped, residuals, controls.where("market = 'calm'")).first()["history"] == "supported_with_warning"


def test_resampling_of_blocks(spark):
    """The p-value against orders made by hand."""
    rng = np.random.default_rng(2)
    r, level = rng.normal(size=40), np.arange(40.0)
    rows = [("m", d, float(x), float(z)) for (_, d, _), x, z in zip(series("m", 40, lambda k: 0), r, level, strict=True)]
    got = contract.scale_association(spark.createDataFrame(rows, "market string, date date, residual double, level double"), block=7, resamples=50, seed=5).first()
    from hashlib import md5

    square = (r - r.mean()) ** 2
    corr = lambda s: np.corrcoef(level, s)[0, 1]
    null = [corr(np.concatenate([square[b * 7 : b * 7 + 7] for b in sorted(range(6), key=lambda b: md5(f"5:{k}:{b}".encode()).hexdigest())])) for k in range(1, 51)]
    assert got["association"] == pytest.approx(corr(square)) and got["p_value"] == pytest.approx((1 + sum(abs(x) >= abs(corr(square)) - 1e-12 for x in null)) / 51)


def test_effective_sizes(spark):
    """Independent draws count whole, an AR(1) chain by (1 - rho) / (1 + rho), and chains apart have a large R-hat."""
    rng = np.random.default_rng(1)

    def ar(rho, n):
        x = np.zeros(n)
        for k in range(1, n):
            x[k] = rho * x[k - 1] + rng.normal()
        return x

    chains = {("plain", c): rng.normal(size=600) for c in range(4)} | {("ar", c): ar(0.7, 600) for c in range(4)} | {("apart", c): rng.normal(size=300) + 5 * c for c in range(2)}
    rows = [(p, c, k, float(v)) for (p, c), x in chains.items() for k, v in enumerate(x)]
    x = posterior.convergence(spark.createDataFrame(rows, "parameter string, chain int, draw int, value double"))
    got = {r["parameter"]: r for r in x.collect()}
    assert 0.75 * 2400 < got["plain"]["ess"] < 1.3 * 2400 and 0.7 < got["ar"]["ess"] / (2400 * 0.3 / 1.7) < 1.35
    assert got["plain"]["r_hat_ok"] and got["plain"]["ess_ok"] and got["plain"]["mcse_ok"] and got["apart"]["r_hat"] > 2 and not got["apart"]["ess_ok"]
    assert (got["plain"]["n_chains"], got["plain"]["n_draws"]) == (8, 300)
    assert posterior.convergence_summary(x.where("parameter = 'plain'"), 0).first()["ok"] is True
    assert posterior.convergence_summary(x.where("parameter = 'plain'"), 1).first()["ok"] is False and posterior.convergence_summary(x).first()["ok"] is False


def test_staleness_of_a_graph(spark):
    """A change marks its descendants and no other stage; a restored input completes them again."""
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e")], "parent string, child string")
    rows = [(1, s, "completed", "1", "2" if s == "c" else "1") for s in "abcd"] + [(1, "e", "not_started", None, "1"), (1, "z", "completed", "1", "1")]
    rows += [(2, s, "stale", "1", "1") for s in "abd"] + [(2, "c", "completed", "1", None), (2, "e", "planned", "1", "9")]
    got = {(r["experiment"], r["stage"]): (r["stale"], r["new_status"], r["changed"]) for r in lineage.staleness(spark.createDataFrame(rows, "experiment int, stage string, status string, stored string, current string"), edges).collect()}
    assert {k[1] for k, v in got.items() if v[0]} == {"c", "d"} and all(k[0] == 1 for k, v in got.items() if v[0])
    assert got[1, "e"] == (False, "not_started", False) and got[2, "e"] == (False, "planned", False)
    assert all(got[2, s] == (False, "completed", True) for s in "abd") and got[2, "c"] == (False, "completed", False)
    assert lineage.stage_edges(spark).count() == 5


def test_documents_path_by_path(spark):
    docs = [(1, {"a": {"b": [1, {"c": None}, []]}, "d": True, "e": "x.y", "f": 1.5, "g": {}}), (2, [])]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in docs] + [(3, "{broken"), (4, None)], "key int, doc string")
    got = {(r["key"], r["path"]): (r["type"], r["value"]) for r in lineage.flattened(df).collect()}
    assert got == {(1, "$.a.b[0]"): ("number", "1"), (1, "$.a.b[1].c"): ("null", None), (1, "$.a.b[2]"): ("array", None), (1, "$.d"): ("boolean", "true"), (1, "$.e"): ("string", "x.y"), (1, "$.f"): ("number", "1.5"), (1, "$.g"): ("object", None), (2, "$"): ("array", None), (3, "$"): ("invalid", None), (4, "$"): ("invalid", None)}
    other = spark.createDataFrame([(1, json.dumps({"a": {"b": ["1"]}, "d": True}))], "key int, doc string")
    both = lineage.compared(lineage.flattened(df.where("key = 1")), lineage.flattened(other))
    states = {r["path"]: r["state"] for r in both.collect()}
    assert states["$.a.b[0]"] == "changed" and states["$.d"] == "same" and states["$.e"] == "only_planned"
    assert lineage.comparison_summary(both).first()["matches"] is False
    with pytest.raises(ValueError):
        lineage.flattened(df, deepest=2)


def test_records_compared_within_their_rows(spark):
    """Odd documents compare as their leaves do: repeated and null keys, names with dots, quotes and brackets, no JSON, one side only."""
    docs = [(1, '{"a": [1, {}, []], "b.c": 1, "b": {"c": 2}, "x[\\"]{": "}"}'), (2, "[]"), (3, "{broken"), (4, None), (5, '{"d": "1", "e": null}'), (6, '{"d": 1}'), (6, '{"d": 2}'), (None, '{"n": 1}'), (8, '"s"'), (9, '{"a": {"b": {"c": [[]]}}}')]
    other = [(1, '{"a": [1, {}, [0]], "b.c": 1, "b": {"c": 2}, "x[\\"]{": "}"}'), (2, "{}"), (3, "{other"), (5, '{"d": 1, "e": "null"}'), (6, '{"d": 1, "f": 3}'), (None, '{"n": 1}'), (7, "[[1]]"), (8, '"s"'), (9, '{"a": {"b": {"c": [[]]}}}')]
    a, b = (spark.createDataFrame(x, "key int, doc string") for x in (docs, other))
    want = lineage.comparison_summary(lineage.compared(lineage.flattened(a), lineage.flattened(b)))
    got = lineage.record_comparison(a, b)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    rows = {r["key"]: tuple(r) for r in got.collect()}
    assert rows == {r["key"]: tuple(r) for r in want.collect()} and len(rows) == 10
    assert rows[6][1:] == (False, 1, 1, 0, 1, "$.d,$.f") and rows[9][1:] == (True, 1, 0, 0, 0, "") and rows[None][1:] == (False, 0, 0, 1, 1, "$.n,$.n")
    with pytest.raises(ValueError):
        lineage.record_comparison(a, b, deepest=4)
    assert lineage.record_comparison(a, b, deepest=5).count() == 10


def test_record_comparison_parses_a_document_once(spark, sf_dir):
    from quadrat import queries as own

    plan = own.queries()["j16_compared_records"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.count("parseJson") <= 2 and "Generate" not in plan and "Join" not in plan


def test_workbook_source(spark, tmp_path):
    long = [(f"r{k}", k, None) for k in range(300)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "one.xlsx").write_bytes(workbook.workbook_bytes({"UK": ([" Region ", "Metric", ""], long), "DE": (["Region"], [("x",)])}))
    (tmp_path / "deep" / "two.xlsx").write_bytes(workbook.workbook_bytes({"FR": (["Region"], [])}))
    book = workbook.open_workbooks(spark, f"file://{tmp_path}")
    assert book.rdd.getNumPartitions() == 3 and book.count() == 304
    assert [r["cells"][:2] for r in book.where("sheet = 'UK' and row in (0, 300)").orderBy("row").collect()] == [[" Region ", "Metric"], ["r299", "299"]]
    heads = {r["sheet"]: (r["header"][:2], r["n_peeked"]) for r in workbook.headers(spark, str(tmp_path), 2).collect()}
    assert heads["UK"] == (["Region", "Metric"], 2) and heads["DE"] == (["Region"], 2) and heads["FR"] == (["Region"], 1)
    assert workbook.open_workbooks(spark, str(tmp_path / "one.xlsx"), sheet="DE").count() == 2
    before = {r["path"]: r["identity"] for r in workbook.identities(book).collect()}
    (tmp_path / "one.xlsx").write_bytes(workbook.workbook_bytes({"DE": (["Region"], [("changed",)])}))
    after = {r["path"]: r["identity"] for r in workbook.identities(workbook.open_workbooks(spark, str(tmp_path))).collect()}
    assert sorted(before[p] == after[p] for p in before) == [False, True]
    (tmp_path / "broken.xlsx").write_bytes(b"PK no workbook")
    with pytest.raises(Exception, match=UnreadableWorkbook.__name__):
        workbook.open_workbooks(spark, str(tmp_path)).count()
    with pytest.raises(Exception, match="no such file"):
        workbook.open_workbooks(spark, str(tmp_path / "absent")).count()


@pytest.mark.parametrize("weights", [None, {"f0": 3.0, "f2": 0.0}])
def test_arrays_score_as_groups(spark, weights):
    rng = np.random.default_rng(6)
    regions = [f"r{k:02d}" for k in range(12)]
    wide = [(r, 0.0 if k in (4, 5) else float(rng.integers(1, 90)), *map(float, rng.normal(size=3)), 2.0) for k, r in enumerate(regions)]
    long = matching.long_features(spark.createDataFrame(wide, "region string, population double, f0 double, f1 double, f2 double, flat double"), ["f0", "f1", "f2", "flat"], ["region", "population"])
    test = spark.createDataFrame([("r00",), ("r03",)], "region string")
    groups = {k: rng.choice(np.arange(1, 12), rng.integers(1, 6), replace=False).tolist() for k in range(40)} | {40: [4, 5]}
    want = {r["group_id"]: r for r in matching.score_groups(spark.createDataFrame([(k, regions[j]) for k, v in groups.items() for j in v], "group_id int, region string"), long, test, weights).collect()}
    got = {r["group_id"]: r for r in matching.score_arrays(spark.createDataFrame([*groups.items(), (41, [])], "group_id int, members array<int>"), long, test, weights).collect()}
    for k in groups:
        assert got[k]["distance"] == pytest.approx(want[k]["distance"], abs=1e-12) and got[k]["mean_abs_smd"] == pytest.approx(want[k]["mean_abs_smd"], abs=1e-12)
    assert got[41]["distance"] is None and got[41]["mean_abs_smd"] is None
