"""Queries of operators/shaping.py; registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.operators import matching, roles, shaping, validation
from quadrat.queries import DAYS, FITTED, LONGF, MONTHS, STATS, TEST_SQL, WEEKS, fitted_naive, long_features, months, query, r, test_regions, weeks
from quadrat.sources import panel as sp

CASES = "SELECT c_custkey, c_mktsegment AS metric, CASE WHEN c_acctbal < 0 THEN '  ' ELSE c_mktsegment || c_nationkey END AS level, c_acctbal FROM customer"


def cases(spark, d):
    level = F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")))
    return sp.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("metric"), level.alias("level"), "c_acctbal")


@query("p6_without_empty_axes", "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 200000 THEN o_orderpriority END AS p FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT NULL, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1 AND o_totalprice > 200000")
def p6(spark, d):
    o = sp.table(spark, d, "orders")
    return shaping.drop_empty_axes(o.select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("k"), F.when(F.col("o_totalprice") > 200000, F.col("o_orderpriority")).alias("p"), F.lit(None).cast("string").alias("empty")))


@query("p12_metric_view", f"SELECT level, COUNT(*) AS n FROM ({CASES}) WHERE metric = 'BUILDING' AND trim(level) <> '' GROUP BY 1")
def p12(spark, d):
    return shaping.without_blank_level(shaping.metric_view(cases(spark, d), "metric", "BUILDING"), "level").groupBy("level").agg(F.count("*").alias("n"))


@query("p13_blank_levels", f"SELECT metric, COUNT(*) FILTER (trim(level) <> '') AS kept, COUNT(*) FILTER (trim(level) = '') AS dropped FROM ({CASES}) GROUP BY 1")
def p13(spark, d):
    return shaping.blank_level_counts(cases(spark, d), "metric", "level")


@query("p17_numeric_features", "SELECT 'key' AS feature, 1.0::DOUBLE AS numeric_share UNION ALL SELECT 'mixed', ROUND(COUNT(*) FILTER (c_acctbal > 0) / COUNT(*), 6) FROM customer HAVING COUNT(*) FILTER (c_acctbal > 0) > 0.5 * COUNT(*)")
def p17(spark, d):
    c = sp.table(spark, d, "customer")
    text = c.select(F.col("c_custkey").cast("string").alias("key"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("mixed"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("region_code"))
    return shaping.numeric_features(text).select("feature", r("numeric_share", 6).alias("numeric_share"))


@query("p18_population_column", "SELECT c_mktsegment AS segment, COUNT(*) AS \"Population\" FROM customer GROUP BY 1")
def p18(spark, d):
    return shaping.standard_population(sp.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("Total Population")))


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("p23_proportions", " UNION ALL ".join(f"SELECT '{c}' AS feature, MIN({c}) >= 0 AND MAX({c}) <= 1 AS is_proportion FROM lineitem" for c in MEASURES))
def p23(spark, d):
    return shaping.proportions(sp.table(spark, d, "lineitem"), list(MEASURES))


def spine(spark, first, last):
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("date"))


@query("p26_missing_holdout_dates", f"SELECT date FROM (SELECT UNNEST(generate_series(DATE '1990-06-01', DATE '1999-12-01', INTERVAL 1 MONTH))::DATE AS date) WHERE date NOT IN (SELECT date FROM ({MONTHS}))")
def p26(spark, d):
    return shaping.missing_dates(months(spark, d), spine(spark, "1990-06-01", "1999-12-01"))


@query("p27_dates_after_history", f"SELECT DISTINCT date FROM ({WEEKS}) WHERE date > DATE '1996-12-31'")
def p27(spark, d):
    return shaping.dates_after(weeks(spark, d), F.lit("1996-12-31").cast("date"))


@query("r5_quality_totals", f"SELECT date, COUNT(DISTINCT region) AS regions, ROUND(SUM(kpi), 2) AS kpi FROM ({MONTHS}) GROUP BY 1")
def r5(spark, d):
    return months(spark, d).groupBy("date").agg(F.countDistinct("region").alias("regions"), r(F.sum("kpi"), 2).alias("kpi"))


NAMES = ("NATION_1", "NATION_2", "NATION_30")


@query("r6_date_matrix", f"SELECT s.date, {', '.join(f'''ROUND(MAX(kpi) FILTER (region = '{n}'), 2) AS {n.lower()}''' for n in NAMES)} FROM (SELECT UNNEST(generate_series(DATE '1990-06-01', DATE '1999-12-01', INTERVAL 1 MONTH))::DATE AS date) AS s LEFT JOIN ({MONTHS}) AS m ON m.date = s.date GROUP BY 1")
def r6(spark, d):
    own = shaping.date_matrix(months(spark, d), spine(spark, "1990-06-01", "1999-12-01"), list(NAMES))
    return own.select("date", *(r(n, 2).alias(n.lower()) for n in NAMES))


@query("j15_target_effects", f"""{FITTED}, thr AS (SELECT quantile_cont(uplift_pct, 0.95) AS hi FROM pw), c AS (SELECT e, AVG(CASE WHEN uplift_pct * (1 + e / 100) + e > hi THEN 1.0 ELSE 0.0 END) AS p FROM pw, thr, (SELECT UNNEST(range(1, 61)) * 0.5::DOUBLE AS e) GROUP BY 1)
SELECT x::DOUBLE AS effect_pct, ROUND(p, 6) AS power FROM (SELECT UNNEST([2.0, 10.0, 25.0, 99.0]) AS x) LEFT JOIN c ON e = x""")
def j15(spark, d):
    curve = validation.power_curve(validation.placebo_windows(fitted_naive(spark, d), 4))
    targets = spark.createDataFrame([(2.0,), (10.0,), (25.0,), (99.0,)], "effect_pct double")
    return targets.join(curve, "effect_pct", "left").select("effect_pct", r("power_lift", 6).alias("power"))


@query("j18_enriched_candidates", f"SELECT m.region, m.date, ROUND(m.kpi, 2) AS kpi, ROUND(t.total, 2) AS total, ROUND(100 * m.kpi / t.total, 6) AS share_pct FROM ({MONTHS}) AS m, (SELECT SUM(kpi) AS total FROM ({MONTHS})) AS t")
def j18(spark, d):
    m = months(spark, d)
    one = m.agg(F.sum(F.col("kpi").cast("decimal(38,2)")).cast("double").alias("total"))
    return m.crossJoin(F.broadcast(one)).select("region", "date", r("kpi", 2).alias("kpi"), r("total", 2).alias("total"), r(100 * F.col("kpi") / F.col("total"), 6).alias("share_pct"))  # one row


@query("w14_gap_steps", f"SELECT region, date, GREATEST(ROUND(date_diff('day', date, LEAD(date) OVER (PARTITION BY region ORDER BY date)) / 7.0), 1)::BIGINT AS steps FROM ({WEEKS}) QUALIFY LEAD(date) OVER (PARTITION BY region ORDER BY date) IS NOT NULL")
def w14(spark, d):
    from pyspark.sql import Window

    following = F.lead("date").over(Window.partitionBy("region").orderBy("date"))
    return weeks(spark, d).select("region", "date", following.alias("next")).where("next is not null").select("region", "date", shaping.gap_steps(F.col("date"), F.col("next"), 7).alias("steps"))


@query("b8_contiguity_blockers", f"SELECT region, COUNT(*) AS gaps FROM (SELECT region, date_diff('day', LAG(date) OVER (PARTITION BY region ORDER BY date), date) AS gap FROM ({DAYS} UNION ALL {MONTHS})) WHERE gap <> 1 GROUP BY 1")
def b8(spark, d):
    both = sp.event_panel(spark, d).select("region", "date").unionByName(months(spark, d).select("region", "date"))
    return shaping.contiguity_blockers(both, 1)


LISTS = "SELECT CASE c_custkey % 4 WHEN 0 THEN c_custkey || ', ' || c_nationkey || '.5,,x' WHEN 1 THEN ' ' || c_custkey || ' ' WHEN 2 THEN '' ELSE 'a=' || c_custkey || ', b = ' || c_nationkey || '.5,c,d=z' END AS s FROM customer"


@query("f4_parsed_lists", f"WITH t AS ({LISTS}), n AS (SELECT s, list_transform(list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: TRY_CAST(x AS DOUBLE)) AS v FROM t) SELECT s, len(v)::INTEGER AS n, COALESCE(list_sum(v), 0)::DOUBLE AS total, len(list_filter(v, lambda x: x IS NULL))::INTEGER AS invalid, list_sum(list_transform(list_filter(string_split(s, ','), lambda x: x LIKE '%=%'), lambda x: TRY_CAST(trim(string_split(x, '=')[2]) AS DOUBLE)))::DOUBLE AS weights FROM n")
def f4(spark, d):
    v, w = shaping.number_list(F.col("s")), F.map_values(shaping.key_values(F.col("s")))
    add = lambda x: F.aggregate(F.filter(x, lambda y: y.isNotNull()), F.lit(0.0), lambda a, y: a + y)
    k, n = (F.col(c).cast("string") for c in ("c_custkey", "c_nationkey"))
    text = F.when(F.col("c_custkey") % 4 == 0, F.concat(k, F.lit(", "), n, F.lit(".5,,x"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit(" "), k, F.lit(" "))).when(F.col("c_custkey") % 4 == 2, "").otherwise(F.concat(F.lit("a="), k, F.lit(", b = "), n, F.lit(".5,c,d=z")))
    df = sp.table(spark, d, "customer").select(text.alias("s"))
    return df.select("s", F.size(v).alias("n"), add(v).alias("total"), F.size(F.filter(v, lambda x: x.isNull())).alias("invalid"), F.when(F.size(w) > 0, add(w)).alias("weights"))


@query("f11_weekdays", "SELECT isodow(o_orderdate)::INTEGER - 1 AS weekday, COUNT(*) AS n FROM orders GROUP BY 1")
def f11(spark, d):
    return sp.table(spark, d, "orders").groupBy(F.weekday("o_orderdate").alias("weekday")).agg(F.count("*").alias("n"))


FOLDS = "SELECT region AS method, kpi < 100000 AS fallback, region LIKE '%9' AS main_fallback FROM "


@query("v10_validation_label", f"SELECT method, CASE WHEN bool_or(main_fallback) OR bool_and(fallback) THEN '{shaping.VALIDATION_LABELS[2]}' WHEN bool_or(fallback) THEN '{shaping.VALIDATION_LABELS[1]}' ELSE '{shaping.VALIDATION_LABELS[0]}' END AS label FROM ({FOLDS} ({MONTHS})) GROUP BY 1")
def v10(spark, d):
    return shaping.validation_label(months(spark, d).select(F.col("region").alias("method"), (F.col("kpi") < 100000).alias("fallback"), F.col("region").like("%9").alias("main_fallback")))


@query("v7_row_loss", f"WITH m AS ({MONTHS}), n AS (SELECT region, COUNT(*) AS before, COUNT(*) FILTER (kpi < 300000) AS dropped FROM m GROUP BY 1) SELECT region, before, dropped, CASE WHEN 100.0 * dropped / before > 20 THEN 'error' WHEN 100.0 * dropped / before > 10 THEN 'warning' END AS level FROM n")
def v7(spark, d):
    n = months(spark, d).groupBy("region").agg(F.count("*").alias("before"), F.count_if(F.col("kpi") < 300000).alias("dropped"))
    return n.select("region", "before", "dropped", shaping.row_loss(F.col("dropped"), F.col("before")).alias("level"))


@query("v13_excluded_share", f"WITH p AS (SELECT DISTINCT date FROM ({WEEKS}) WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30') SELECT COUNT(*) AS n_planned, COUNT(*) FILTER (month(date) = 2) AS n_excluded, ROUND(COUNT(*) FILTER (month(date) = 2) / COUNT(*), 6) AS share, COUNT(*) FILTER (month(date) = 2) > 0.2 * COUNT(*) AS triggered FROM p")
def v13(spark, d):
    planned = weeks(spark, d).where("date between date'1997-01-01' and date'1997-06-30'")
    out = shaping.excluded_share(planned, weeks(spark, d).where("month(date) = 2"))
    return out.withColumn("share", r("share", 6))




@query("d12_impact_completed", "WITH t AS (SELECT o_custkey AS run, CASE WHEN o_orderkey % 4 = 0 THEN 'Design' ELSE 'Evaluate' END AS mode, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'nan' WHEN 2 THEN 'x' ELSE o_totalprice::VARCHAR END AS uplift_pct, (o_orderkey % 3 = 0)::INTEGER AS blockers FROM orders) SELECT run, COUNT(*) FILTER (mode = 'Evaluate' AND blockers = 0 AND isfinite(TRY_CAST(uplift_pct AS DOUBLE))) > 0 AS completed FROM t GROUP BY 1")
def d12(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "nan").when(k % 5 == 2, "x").otherwise(F.col("o_totalprice").cast("string"))
    return shaping.impact_completed(sp.table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.when(k % 4 == 0, "Design").otherwise("Evaluate").alias("mode"), text.alias("uplift_pct"), (k % 3 == 0).cast("int").alias("blockers")))


@query("d18_effect_meets_mde", "SELECT (o_custkey % 13 - 6)::DOUBLE AS expected, dir AS direction, CASE dir WHEN 'one_sided_positive' THEN o_custkey % 13 - 6 WHEN 'one_sided_negative' THEN 6 - o_custkey % 13 ELSE ABS(o_custkey % 13 - 6) END >= o_orderkey % 5 AS meets, COUNT(*) AS n FROM orders, (SELECT UNNEST(['one_sided_positive', 'one_sided_negative', 'two_sided']) AS dir) GROUP BY ALL")
def d18(spark, d):
    o = sp.table(spark, d, "orders").select((F.col("o_custkey") % 13 - 6).cast("double").alias("expected"), (F.col("o_orderkey") % 5).cast("double").alias("mde"), F.explode(F.array(*map(F.lit, ("one_sided_positive", "one_sided_negative", "two_sided")))).alias("direction"))
    return o.withColumn("meets", shaping.meets_mde(F.col("expected"), F.col("direction"), F.col("mde"))).groupBy("expected", "direction", "meets").agg(F.count("*").alias("n"))


@query("x21_balance_status", "SELECT ROUND(l_discount * 10, 2) AS smd, CASE WHEN ROUND(l_discount * 10, 2) <= 0.2 THEN 'pass' WHEN ROUND(l_discount * 10, 2) <= 0.5 THEN 'supported' ELSE 'fail' END AS status, COUNT(*) AS n FROM lineitem GROUP BY 1, 2")
def x21(spark, d):
    smd = sp.table(spark, d, "lineitem").select(F.round(F.col("l_discount").cast("double") * 10, 2).alias("smd"))
    return smd.groupBy("smd", shaping.balance_status(F.col("smd")).alias("status")).agg(F.count("*").alias("n"))


@query("d19_blocking_errors", f"SELECT 'broken date' AS error UNION ALL SELECT 'Test regions that no row of the KPI table covers: ' || string_agg(x, ', ' ORDER BY x) FROM (SELECT UNNEST(['NATION_1', 'Nowhere', 'Elsewhere']) AS x) WHERE x NOT IN (SELECT region FROM ({MONTHS})) HAVING COUNT(*) > 0")
def d19(spark, d):
    required = spark.createDataFrame([("NATION_1",), ("Nowhere",), ("Elsewhere",)], "region string")
    return shaping.blocking_errors(spark.createDataFrame([("broken date",)], "error string"), required, months(spark, d))


@query("p17_column_roles", "SELECT 'Total Population' AS \"column\", 'population' AS role UNION ALL SELECT 'segment', 'grouping' UNION ALL SELECT 'spend', 'feature' UNION ALL SELECT 'mostly', 'feature' FROM customer HAVING COUNT(*) FILTER (c_acctbal > 0) > 0.5 * COUNT(*) UNION ALL SELECT 'rarely', 'feature' FROM customer HAVING COUNT(*) FILTER (c_acctbal <= 0) > 0.5 * COUNT(*)")
def p17_roles(spark, d):
    c = sp.table(spark, d, "customer")
    text = lambda when: F.when(when, F.col("c_acctbal").cast("string")).otherwise("n/a")
    few = F.when(F.col("c_acctbal") > 9000, F.col("c_acctbal"))  # numeric by type, though mostly null
    return shaping.column_roles(c.select(F.col("c_nationkey").alias("Market"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("Total Population"), few.alias("spend"), text(F.col("c_acctbal") > 0).alias("mostly"), text(F.col("c_acctbal") <= 0).alias("rarely"), F.col("c_name").alias("customer_name")))


SUPPLIED = "SELECT CASE WHEN n_nationkey % 7 = 3 THEN 'old ' ELSE '' END || n_name AS region, (n_nationkey - 4)::DOUBLE AS weight FROM nation WHERE n_nationkey % 5 <> 0"


@query("x21_weight_problems", f"WITH w AS ({SUPPLIED}), p AS (SELECT DISTINCT region FROM ({WEEKS})) SELECT region, 'missing' AS problem FROM p WHERE region NOT IN (SELECT region FROM w) UNION ALL SELECT region, CASE WHEN region NOT IN (SELECT region FROM p) THEN 'unknown' ELSE 'not_positive' END FROM w WHERE region NOT IN (SELECT region FROM p) OR weight <= 0")
def x21_weights(spark, d):
    k = F.col("n_nationkey")
    supplied = sp.table(spark, d, "nation").where(k % 5 != 0).select(F.concat(F.when(k % 7 == 3, "old ").otherwise(""), "n_name").alias("region"), (k - 4).cast("double").alias("weight"))
    return roles.weight_problems(supplied, weeks(spark, d))


@query("x21_market_weights", f"SELECT region, ROUND(SUM(kpi) FILTER (date <= DATE '1996-12-31'), 2) AS weight FROM ({WEEKS}) GROUP BY 1")
def x21_volumes(spark, d):
    return roles.market_weights(weeks(spark, d), F.lit("1996-12-31").cast("date")).select("region", r("weight", 2).alias("weight"))


#: Roles and groups of suppliers' nations, by remainders of the suppliers' keys.
GIVEN = ", ".join(f"'{x}'" for x in roles.ROLES)
ROLES_SQL = f"known AS (SELECT DISTINCT n_name AS region FROM nation WHERE n_nationkey % 11 <> 10), roles AS (SELECT DISTINCT n_name AS region, [{GIVEN}][s_suppkey % 5 + 1] AS field FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 7 < 3), groups AS (SELECT DISTINCT n_name AS region, CASE WHEN s_suppkey % 3 = 0 THEN 'test' ELSE 'control' END AS side FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 4 < 2)"


def role_tables(spark, d):
    n, k = sp.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("region")), F.col("s_suppkey")
    s = sp.table(spark, d, "supplier").join(n, "s_nationkey")
    given = s.where(k % 7 < 3).select("region", F.element_at(F.array(*map(F.lit, roles.ROLES)), (k % 5 + 1).cast("int")).alias("field"))
    return n.where("s_nationkey % 11 <> 10").select("region"), given, s.where(k % 4 < 2).select("region", F.when(k % 3 == 0, "test").otherwise("control").alias("side"))


@query("x21_role_problems", f"""WITH {ROLES_SQL} SELECT region, 'unknown_role' AS problem FROM roles ANTI JOIN known USING (region) UNION SELECT region, 'unknown_' || side FROM groups ANTI JOIN known USING (region) UNION SELECT region, 'in_both_groups' FROM groups GROUP BY 1 HAVING COUNT(*) > 1
UNION SELECT region, side || '_' || field FROM groups JOIN roles USING (region) WHERE field = 'exclude_from_both' OR (side = 'test' AND field IN ('test_only_exclude', 'force_control_include')) OR (side = 'control' AND field = 'control_only_exclude')
UNION SELECT region, 'without_' || field FROM roles WHERE (field = 'force_test_include' AND region NOT IN (SELECT region FROM groups WHERE side = 'test')) OR (field = 'force_control_include' AND region NOT IN (SELECT region FROM groups WHERE side = 'control'))
UNION SELECT NULL, 'no_control' FROM groups HAVING COUNT(*) FILTER (side = 'control') = 0""")
def x21_problems(spark, d):
    return roles.role_problems(*role_tables(spark, d))


@query("x21_control_regions", f"WITH {ROLES_SQL} SELECT region FROM known WHERE region NOT IN (SELECT region FROM groups WHERE side = 'test') AND region NOT IN (SELECT region FROM roles WHERE field IN ('exclude_from_both', 'control_only_exclude', 'force_test_include'))")
def x21_controls(spark, d):
    known, given, groups = role_tables(spark, d)
    return roles.control_regions(known, groups.where("side = 'test'"), given)


@query("x21_selection_status", "WITH t AS (SELECT l_orderkey AS choice, AVG(l_discount) FILTER (l_quantity > 10) * 6 AS m, COUNT(*) FILTER (l_quantity <= 10) = 0 AS varies FROM lineitem GROUP BY 1) SELECT choice, CASE WHEN m IS NULL THEN 'supported' WHEN m <= 0.2 THEN 'pass' WHEN m <= 0.5 THEN 'supported' ELSE 'fail' END AS status, CASE WHEN m IS NULL THEN 'no feature varies' WHEN m <= 0.2 THEN NULL WHEN m <= 0.5 THEN 'above good' ELSE 'above high' END AS reason FROM t")
def x21_selection(spark, d):
    """Discounts are added in the table's order (file, row), as sums of doubles in another order fall on either side of a threshold that a mean meets exactly."""
    smd = F.when(F.col("l_quantity") > 10, F.col("l_discount").cast("double"))
    rows = sp.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("choice"), F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), smd.alias("smd")).alias("x"))
    smds = rows.groupBy("choice").agg(F.array_sort(F.collect_list("x"))["smd"].alias("smds"))  # features of one choice
    known = F.filter("smds", lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x), F.size(known))
    own = smds.select("choice", (mean * 6).alias("m"), F.transform("smds", lambda x: F.coalesce(x, F.lit(float("nan")))).alias("smds"))
    return own.select("choice", roles.selection_status(F.col("m"), F.col("smds")).alias("s")).select("choice", "s.status", "s.reason")


@query("o3_balance_order", f"""WITH {LONGF}, {STATS}, {TEST_SQL}, tp AS (SELECT feature, SUM(value * population) / SUM(population) AS t FROM lf SEMI JOIN t USING (region) GROUP BY 1), cp AS (SELECT feature, SUM(value * population) / SUM(population) AS c FROM lf ANTI JOIN t USING (region) GROUP BY 1),
b AS (SELECT feature, CASE WHEN sd > 0 THEN ABS(t - c) / sd END AS x FROM tp JOIN cp USING (feature) JOIN st USING (feature)) SELECT feature, row_number() OVER (ORDER BY x DESC NULLS LAST, feature)::BIGINT AS place FROM b""")
def o3(spark, d):
    long, test = long_features(spark, d), test_regions(spark, d)
    out = roles.ordered_balance(matching.balance_table(long, test, long.select("region").distinct().join(test, "region", "left_anti")))
    listed = out.agg(F.collect_list("feature").alias("f"))  # features of one experiment, in the table's order
    return listed.select(F.posexplode("f").alias("place", "feature")).select("feature", (F.col("place") + 1).cast("long").alias("place"))


@query("v7_fallback_messages", f"SELECT method, CASE WHEN bool_or(main_fallback) THEN 'main' ELSE 'folds' END AS message, COUNT(*) FILTER (fallback) AS n_fallback, COUNT(*) AS n_folds FROM ({FOLDS} ({MONTHS})) GROUP BY 1 HAVING bool_or(main_fallback) OR bool_or(fallback)")
def v7_messages(spark, d):
    return roles.fallback_messages(months(spark, d).select(F.col("region").alias("method"), (F.col("kpi") < 100000).alias("fallback"), F.col("region").like("%9").alias("main_fallback")))


@query("d18_delivery_cost", "SELECT o_orderkey AS plan, CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 5 IN (0, 3, 4) THEN o_totalprice::DOUBLE END AS cost FROM orders")
def d18_cost(spark, d):
    k = F.col("o_orderkey")
    budget = F.when(k % 5 == 1, "unknown").when(k % 5 == 2, "Infinity").otherwise(F.col("o_totalprice").cast("string"))
    return sp.table(spark, d, "orders").select(k.alias("plan"), roles.delivery_cost(budget, k % 4 > 0).alias("cost"))
