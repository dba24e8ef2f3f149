"""Rules that SQL twins don't reach: layouts, errors, missing values, order of rows, streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from quadrat.functions import columns as fc
from quadrat.operators import decisions, ingest, matching, power, validation
from quadrat.schemas import AmbiguousLayout, DuplicateKeys, NoDateColumns, NoMetricColumn

D = [f"2024-01-{7 * k + 1:02d}" for k in range(4)]


def test_layouts():
    assert ingest.resolve_layout(["Region", "Metric", *D]).region == "Region"
    with pytest.raises(NoDateColumns):
        ingest.resolve_layout(["Region", "Metric"])
    with pytest.raises(AmbiguousLayout):
        ingest.resolve_layout(["Store", "Region", "Metric", *D])
    with pytest.raises(AmbiguousLayout):
        ingest.resolve_layout(["Store", "Region", "Metric", *D], "Town")
    with pytest.raises(NoMetricColumn):
        ingest.resolve_layout(["Store", "Region", "Kind", *D], "Region")
    assert ingest.resolve_layout(["Store", "Region", "Metric", *D], "Region").aggregation == "Region"


@pytest.fixture
def wide(spark):
    rows = [("a", "s1", "Sales", "1", None, "x", "0"), ("a", "s2", "Sales", "2", None, "5", "NaN"), (" ", "s3", "Sales", "9", "9", "9", "9"), ("b", "s4", "Sales", "-1", "4", "", "2")]
    return spark.createDataFrame(rows, f"Region string, Store string, Metric string, {', '.join(f'`{d}` string' for d in D)}")


def test_missing_is_not_zero(wide):
    long = ingest.melt(wide, ingest.resolve_layout(wide.columns, "Region"))
    got = {(r["region"], str(r["date"])): (r["kpi"], r["source_row_count"]) for r in ingest.canonical(long, "Region").collect()}
    assert got["a", D[0]] == (3.0, 2) and got["a", D[1]] == (None, 2) and got["a", D[2]] == (5.0, 2) and got["a", D[3]] == (0.0, 2)
    assert got["b", D[2]] == (None, 1) and ("", D[0]) not in got
    q = ingest.quality_report(long).first()
    assert (q["n_cells"], q["n_blank_region"], q["n_missing"], q["n_non_numeric"], q["n_zero"], q["n_negative"]) == (16, 4, 3, 2, 1, 1)
    assert sorted(r["reject"] for r in ingest.rejects(long).collect()) == ["missing value"] * 3 + ["non-numeric value"] * 2


def test_fingerprints_ignore_order_only(wide):
    f = lambda d: ingest.fingerprint(d).first()["fingerprint"]
    assert f(wide) == f(wide.orderBy(F.desc("Store")).repartition(3))
    assert f(wide) != f(wide.union(wide.limit(1))) and f(wide) != f(wide.withColumn("Store", F.lit("s")))
    assert f(wide.select(F.lit(1).alias("x"))) != f(wide.select(F.lit("1").alias("x")))


def test_repeated_keys_are_refused(wide):
    with pytest.raises(DuplicateKeys):
        ingest.require_unique(wide, ["Region"])
    assert ingest.require_unique(wide, ["Store"]) is wide


def panel(spark, rows):
    return spark.createDataFrame([(r, datetime.date.fromisoformat(d), k) for r, d, k in rows], "region string, date date, kpi double")


def test_period_classes(spark):
    rows = [(f"r{k}", D[0], 0.0) for k in range(10)] + [(f"r{k}", D[1], 0.0 if k < 8 else 1.0) for k in range(10)] + [(f"r{k}", D[2], 1.0) for k in range(4)] + [(f"r{k}", D[3], 1.0) for k in range(9)]
    got = {str(r["date"]): r["period_class"] for r in ingest.period_quality(panel(spark, rows)).collect()}
    assert got == {D[0]: "definite_market_wide_zero", D[1]: "possible_widespread_outage", D[2]: "missing_market_wide_period", D[3]: "normal"}


def test_lags_never_borrow(spark):
    p = panel(spark, [("a", D[0], 1.0), ("a", D[2], 3.0), ("a", D[3], 4.0)])
    assert [(str(r["date"]), r["kpi"]) for r in validation.calendar_lags(p, [1], 7).collect()] == [(D[3], 3.0)]


def test_compositions(spark):
    p = panel(spark, [("a", D[0], 1.0), ("b", D[0], None), ("a", D[1], 1.0), ("b", D[1], 2.0)])
    part = {str(r["date"]): r["test_kpi"] for r in validation.test_series(p, ["a", "b"]).collect()}
    whole = {str(r["date"]): r["test_kpi"] for r in validation.test_series(p, ["a", "b"], "complete").collect()}
    assert part == {D[0]: 1.0, D[1]: 3.0} and whole == {D[0]: None, D[1]: 3.0}


def test_irregular_gaps(spark):
    p = panel(spark, [("a", "2024-01-01", 1.0), ("a", "2024-01-08", 1.0), ("a", "2024-01-13", 1.0)])
    r = ingest.cadence(p, ["region"]).first()
    assert (r["gcd_gap"], r["gcd_cadence"], r["median_cadence"]) == (1, "daily", "weekly")


def test_hand_computed_metrics(spark):
    df = spark.createDataFrame([("g", datetime.date(2024, 1, k), a, p) for k, a, p in ((1, 10.0, 8.0), (2, 0.0, 0.0), (3, 4.0, 6.0))], "g string, date date, actual double, predicted double")
    m = validation.error_metrics(df, ["g"]).first()
    assert m["smape"] == pytest.approx((2 / 9 + 0 + 2 / 5) / 3 * 100) and m["rmse"] == pytest.approx((8 / 3) ** 0.5)
    dw = validation.durbin_watson(df.select("g", "date", (F.col("actual") - F.col("predicted")).alias("residual")), ["g"]).first()
    assert dw["durbin_watson"] == pytest.approx((4 + 4) / 8)


def test_worst_status(spark):
    r = spark.range(1).select(power.worst_status(F.lit("supported"), F.lit("unsupported"), F.lit("supported_with_warning")).alias("s")).first()
    assert r["s"] == "unsupported"


def test_errors_tokens_and_labels(spark):
    df = spark.createDataFrame([("#N/A", " x "), ("1,5", None), ("7", "wk_20240107")], "v string, l string")
    got = df.select(fc.drop_error_tokens(F.col("v")).alias("v"), fc.number(F.col("v")).alias("n"), fc.clean_label(F.col("l")).alias("l"), fc.kpi_feature_label(F.col("l")).alias("k")).collect()
    assert [(r["v"], r["n"], r["l"]) for r in got] == [(None, None, "x"), ("1,5", None, ""), ("7", 7.0, "wk_20240107")]
    assert got[2]["k"] == "07 Jan 24"


def test_hill_climb_is_no_worse_than_the_nearest():
    import numpy as np

    rng = np.random.default_rng(4)
    z, pop, t, w = rng.normal(size=(30, 4)), rng.uniform(1, 9, 30), rng.normal(size=4), np.ones(4)
    for n in (2, 5):
        near = list(np.argsort(((z - t) ** 2).sum(1))[:n])
        group, score = matching.hill_climb(z, pop, t, w, n)
        assert score <= matching._distance(z, pop, t, w, near) and len(set(group)) == n
        assert score == pytest.approx(matching._distance(z, pop, t, w, group))
        again = matching.stochastic_search(z, pop, t, w, n, 200)
        assert again == matching.stochastic_search(z, pop, t, w, n, 200)


def test_weekly_presets_keep_the_total(spark):
    for shape in ("even", "front", "back"):
        got = spark.range(1).select(decisions.weekly_preset(1000.01, 7, shape).alias("x")).first()["x"]
        assert round(sum(got), 2) == 1000.01


def test_stream_equals_batch(spark, sf_dir):
    from quadrat.sources.panel import event_panel
    from quadrat.streaming import panel_stream

    got = panel_stream.run_once(panel_stream.daily_panel(panel_stream.read_events(spark, sf_dir)))
    assert got.exceptAll(event_panel(spark, sf_dir)).count() == 0


def test_workbooks_round_trip(spark, tmp_path):
    from quadrat.sources import workbook

    data = workbook.workbook_bytes({"UK": (["Region", "Metric", "2024-01-01"], [("a & <b>", "Sales", 1.5), ("ü", None, 2)]), "A name of far more than thirty-one characters": (["x"], [("1",)])})
    (tmp_path / "w.xlsx").write_bytes(data)
    book = workbook.read_workbooks(spark, f"file://{tmp_path}")
    assert sorted(r["sheet"] for r in book.select("sheet").distinct().collect()) == ["A name of far more than thirty-", "UK"]
    got = workbook.sheet_frame(book, "UK").orderBy("Region").collect()
    assert [tuple(r) for r in got] == [("UK", "a & <b>", "Sales", "1.5"), ("UK", "ü", None, "2")]


def test_records():
    from quadrat.operators import records

    r = records.Record(records.new_experiment_id(), "2026-01-01")
    r = r.with_stage("match", {"a": 1}, {"n": 3}).with_stage("power", {"p": float("nan")}, {"mde": 2.0})
    assert not r.is_stale("power", {"p": float("nan")}) and r.is_stale("power", {"p": 1})
    again = r.with_stage("match", {"a": 2}, {"n": 4})
    assert again.stale == ("power",) and r.stale == ()
    with pytest.raises(ValueError):
        again.freeze()
    frozen = r.freeze()
    assert records.load_record(frozen.to_json()).frozen["fingerprint"] == records.fingerprint(r.stages)
    with pytest.raises(ValueError):
        frozen.freeze()
    assert records.canonical_json({"b": {2, 1}, "a": float("inf")}) == '{"a":"Infinity","b":[1,2]}'
    assert [x[3] for x in records.planned_and_analysed({"a": 1, "b": 2, "c": 3}, {"b": 2, "c": 4, "d": 5})] == ["only_planned", "same", "changed", "only_analysed"]


def test_guided_test_group_of_many_regions(spark):
    """Of 40 candidates the stated random subsets are tried, and every candidate may be in the group."""
    import hashlib

    draw = lambda *x: int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:8], 16)
    size = {f"r{k:02}": float(10 + k * k % 37) for k in range(42)}
    names, total = [r for r in sorted(size) if r not in ("r00", "r41")], sum(size.values())
    for seed in (0, 3):
        tried = [sorted(sorted(names, key=lambda r: (draw(seed, s, r), r))[: draw(seed, s) % 41]) for s in range(2000)] + [[]]
        scored = []
        for g in tried:
            share = size["r41"] + sum(size[r] for r in g)
            share /= total
            dist = 0.0 if 0.39 <= share <= 0.41 else min(abs(share - 0.39), abs(share - 0.41))
            scored.append((dist, round(abs(share - 0.4), 12), len(g) + 1, sorted([*g, "r41"])))
        df = spark.createDataFrame(list(size.items()), "region string, population double").repartition(5)
        got = matching.guided_test_group(df, 40.0, 1.0, forced=["r41"], barred=["r00"], seed=seed).first()
        assert got["test_group"] == ", ".join(min(scored)[3]) and got["met"]
    assert any("r39" in g or "r40" in g for g in tried)
    assert matching.guided_test_group(df, 40.0, 1.0, forced=["nowhere"]).first() == ("", 0.0, False)
    few = matching.guided_test_group(df.where("region < 'r05'"), 50.0, 5.0).first()
    assert few["met"] and "r00" in size


def test_sized_groups_of_many_regions():
    from quadrat.plans import sizing

    size = {f"r{k:02}": float(10 + k * k % 37) for k in range(40)}
    got = [sizing.test_group(size, s) for s in (0.1, 0.3, 0.5)]
    assert all(abs(sum(size[r] for r in g) / sum(size.values()) - s) < 0.01 for g, s in zip(got, (0.1, 0.3, 0.5), strict=True))
    assert got == [sizing.test_group(size, s) for s in (0.1, 0.3, 0.5)] and any(r > "r16" for g in got for r in g)
