"""Rules of shaping.py and roles.py on empty, repeated and odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quadrat import queries as own
from quadrat.operators import evidence, matching, roles, shaping
from quadrat.schemas import NoPopulationColumn


def test_empty_axes(spark):
    df = spark.createDataFrame([(1, None, None), (None, None, None), (None, "x", None)], "a int, `b.c` string, d string")
    assert [tuple(r) for r in shaping.drop_empty_axes(df).collect()] == [(1, None), (None, "x")]
    assert shaping.drop_empty_axes(df.limit(0)).columns == df.columns
    assert shaping.drop_empty_axes(df.where("a is null and d is null and `b.c` is null")).count() == 0


def test_column_roles(spark):
    df = spark.createDataFrame([("m", "a", "z", 1, None, "1", "x"), ("m", "b", "z", 2, None, "2", "3"), ("m", "c", "z", 2, 5.0, "n", "y")], "Market string, town string, `Adobe Region` string, ` population` int, spend double, clicks string, rare string")
    got = {tuple(r) for r in shaping.column_roles(df).collect()}
    assert got == {(" population", "population"), ("town", "grouping"), ("spend", "feature"), ("clicks", "feature")}
    assert shaping.standard_population(df).columns[3] == "Population"
    assert shaping.grouping_columns(["Market", "Population", "x"]) == ["Population"]
    assert [tuple(r) for r in shaping.numeric_features(df.limit(0), ["town"]).select("feature").collect()] == [(" population",), ("spend",)]
    assert shaping.numeric_features(df.select("town"), ["town"]).count() == 0
    with pytest.raises(NoPopulationColumn):
        shaping.standard_population(df.drop(" population"))


def test_date_matrix_refuses_repeated_keys(spark):
    p = spark.createDataFrame([("a", "2024-01-01", 1.0), ("b", "2024-01-01", None), ("a", "2024-01-02", 3.0)], "region string, date string, kpi double").withColumn("date", F.to_date("date"))
    spine = p.select("date").union(p.select(F.date_add("date", 5)))
    assert {tuple(r)[1:] for r in shaping.date_matrix(p, spine, ["a", "b", "c"]).collect()} == {(1.0, None, None), (3.0, None, None), (None, None, None)}
    with pytest.raises(Exception, match="several rows on 2024-01-01 of region a"):
        shaping.date_matrix(p.union(p), spine, ["a"]).collect()
    assert shaping.date_matrix(p.limit(0), p.limit(0), ["a"]).count() == 0


def test_key_values(spark):
    text = ["a=1,a=2", "b = 1 , c=x, =3, d", "", None, "a=1,b=2,a=3"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in text], "t string").coalesce(1).select(shaping.key_values(F.col("t"))).collect()]
    assert got == [{"a": 2.0}, {"b": 1.0, "c": None, "": 3.0}, {}, None, {"b": 2.0, "a": 3.0}]


def test_no_regions_have_no_share(spark):
    none = spark.createDataFrame([], "region string, population double")
    assert tuple(matching.guided_test_group(none, 30.0, 5.0).first()) == ("", 0.0, False)
    assert tuple(matching.guided_test_group(none, 3.0, 5.0).first()) == ("", 0.0, True)


def test_weights(spark):
    panel = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 3, 1.0), ("c", 1, None)], "region string, date int, kpi double")
    assert {tuple(r) for r in roles.market_weights(panel, F.lit(2)).collect()} == {("a", 5.0), ("b", None), ("c", None)}
    w = spark.createDataFrame([("a", float("inf")), ("b", 0.0), ("d", 1.0)], "region string, weight double")
    assert {tuple(r) for r in roles.weight_problems(w, panel).collect()} == {("a", "not_positive"), ("b", "not_positive"), ("c", "missing"), ("d", "unknown")}
    assert roles.weight_problems(w.where("region = 'z'"), panel.limit(0)).count() == 0


def test_roles(spark):
    known = spark.createDataFrame([(x,) for x in "abcdef"], "region string")
    given = spark.createDataFrame([("a", "exclude_from_both"), ("b", "force_test_include"), ("c", "force_control_include"), ("d", "control_only_exclude"), ("z", "test_only_exclude")], "region string, field string")
    groups = spark.createDataFrame([("a", "test"), ("c", "test"), ("d", "control"), ("e", "test"), ("e", "control"), ("y", "control")], "region string, side string")
    want = {("a", "test_exclude_from_both"), ("c", "test_force_control_include"), ("d", "control_control_only_exclude"), ("e", "in_both_groups"), ("y", "unknown_control"), ("z", "unknown_role"), ("b", "without_force_test_include"), ("c", "without_force_control_include")}
    assert {tuple(r) for r in roles.role_problems(known, given, groups.union(groups)).collect()} == want
    assert (None, "no_control") in {tuple(r) for r in roles.role_problems(known, given, groups.where("side = 'test'")).collect()}
    assert {r[0] for r in roles.control_regions(known, groups.where("side = 'test'"), given).collect()} == {"f"}


def test_selection_status(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0.2, [0.2]), (0.5, [0.5]), (0.51, [0.6]), (nan, [nan, nan]), (None, [None]), (nan, [nan, 0.1]), (inf, []), (None, None)]
    s = spark.createDataFrame(rows, "m double, s array<double>").coalesce(1).select(roles.selection_status(F.col("m"), F.col("s")).alias("x")).collect()
    assert [tuple(r["x"]) for r in s] == [("pass", None), ("supported", "above good"), ("fail", "above high"), ("supported", "no feature varies"), ("supported", "no feature varies"), ("fail", "not finite"), ("fail", "not finite"), ("fail", "not finite")]


def test_selection_status_adds_in_the_order_of_the_table(spark, tmp_path):
    """A mean that meets a threshold exactly: file by file the sum is another double than row by row."""
    db = duckdb.connect(config={"threads": 1})
    at = tmp_path / "lineitem.parquet"
    at.mkdir()
    for k, values in enumerate(("(1, 20, 0.01), (2, 5, 0.3)", "(1, 20, 0.03), (1, 20, 0.04), (1, 20, 0.04), (1, 20, 0.04), (1, 20, 0.04), (1, 3, 0.9), (3, 20, NULL)")):
        db.execute(f"COPY (SELECT a::BIGINT AS l_orderkey, b::DOUBLE AS l_quantity, c::DOUBLE AS l_discount FROM (VALUES {values}) AS t(a, b, c)) TO '{at}/part-{k}.parquet'")
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{at}/*.parquet'")
    want = db.execute(own.oracle_sql()["x21_selection_status"]).fetchall()
    got = own.queries()["x21_selection_status"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) == [(1, "pass", None), (2, "supported", "no feature varies"), (3, "supported", "no feature varies")]


def test_summaries_do_not_share_a_view(spark):
    make = lambda p: spark.createDataFrame([("s", 1, "m", "ols", p, 0.5, 0.1, None), ("s", 2, "m", "ols", p, 0.5, 0.1, "x")], "scenario string, seed int, method string, fit string, power double, reference double, null_rate double, fallback string")
    a, b = evidence.summarise(make(0.25)), evidence.summarise(make(0.75))
    for out, p in ((a, 0.25), (b, 0.75)):
        rows = sorted((r["level"], r["scenario"], r["method"], r["n_runs"], r["power_mean"], r["power_sd"], r["n_fallback"]) for r in out.collect() if r["scenario"])
        assert rows == [(0, "s", "m", 2, p, 0.0, 1), (3, "s", None, 2, p, 0.0, 1)] and out.count() == 3
