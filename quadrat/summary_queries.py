"""Queries of operators/summaries.py, of match results and of evidence rates, over records that orders, customers and line items stand for; registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.operators import evidence, matching, summaries
from quadrat.queries import LONGF, STATS, TEST_SQL, long_features, query, rounded, test_regions
from quadrat.sources import panel as sp

EVIDENCE = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS scenario, o_orderstatus AS method, 'fit' || o_custkey % 3 AS fit, o_orderkey % 7 <> 0 AND NOT (o_orderpriority = '1-URGENT' AND o_custkey % 4 <> 0) AS completed FROM orders),
e AS (SELECT *, CASE scenario WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN true WHEN '5-LOW' THEN NULL ELSE false END AS to_block, NOT completed AND k % 5 = 0 AS failed, c % 10 = 0 AS fell_back, CASE WHEN completed THEN 0 ELSE c % 3 END AS n_blockers, c % 97 / 970 AS power_zero, CASE WHEN k % 11 <> 0 THEN k % 1000 / 1000 END AS power, c % 1000 / 1000 AS reference,
k % 60 / 10 + 0.5 AS mde, c % 50 / 10 AS reference_mde, k % 3 <> 0 AS reached, CASE WHEN c % 13 <> 0 THEN c % 4 <> 0 END AS known, k % 500 / 250 AS seconds FROM o),
r AS (SELECT *, CASE WHEN completed THEN ABS(power_zero - 0.05) END AS null_error, CASE WHEN completed THEN power - reference END AS bias, CASE WHEN completed AND reached AND known AND reference_mde <> 0 THEN ABS(mde - reference_mde) / reference_mde END AS mde_error FROM e),
s AS (SELECT scenario, method, fit, stddev_samp(power) AS sd FROM r WHERE completed AND power IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) > 1)"""


def _spread_sql(c: str, name: str, shares=(0.1, 0.5, 0.9)) -> str:
    return ", ".join(f"ROUND(quantile_cont({c}, {s}), 4) AS {name}_p{round(100 * s)}" for s in shares) + f", ROUND(AVG({c}), 4) AS {name}_mean, COUNT({c}) AS {name}_n"


_RATES = f"""{EVIDENCE}, g AS (SELECT scenario, method, fit, GROUPING(scenario, method, fit)::BIGINT AS level, COUNT(*) AS n_runs, COUNT(*) FILTER (completed) AS n_completed, COUNT(*) FILTER (failed) AS n_failed, COUNT(*) FILTER (NOT completed AND NOT failed) AS n_incomplete, COUNT(*) FILTER (n_blockers > 0) AS n_blocked, COUNT(*) FILTER (fell_back) AS n_fallback,
{_spread_sql('null_error', 'null_error')}, {_spread_sql('bias', 'power_bias')}, {_spread_sql('ABS(bias)', 'power_error')}, ROUND(MAX(ABS(bias)), 4) AS power_error_worst, {_spread_sql('mde_error', 'mde_error')}, {_spread_sql('seconds', 'seconds', (0.5, 0.95))},
COUNT(*) FILTER (to_block AND completed) AS n_false_supported, ROUND(COUNT(*) FILTER (to_block AND completed) / NULLIF(COUNT(*) FILTER (to_block), 0), 4) AS false_supported_rate, COUNT(*) FILTER (NOT to_block AND NOT completed AND NOT failed) AS n_false_blocked, ROUND(COUNT(*) FILTER (NOT to_block AND NOT completed AND NOT failed) / NULLIF(COUNT(*) FILTER (NOT to_block), 0), 4) AS false_blocked_rate,
COUNT(*) FILTER (completed AND reached AND NOT known) AS n_false_mde, ROUND(COUNT(*) FILTER (completed AND reached AND NOT known) / NULLIF(COUNT(*) FILTER (completed AND known IS NOT NULL), 0), 4) AS false_mde_rate FROM r GROUP BY GROUPING SETS ((scenario, method, fit), ())),
h AS (SELECT scenario, method, fit, GROUPING(scenario, method, fit)::BIGINT AS level, {_spread_sql('sd', 'power_sd')} FROM s GROUP BY GROUPING SETS ((scenario, method, fit), ()))
SELECT g.*, h.power_sd_p10, h.power_sd_p50, h.power_sd_p90, h.power_sd_mean, h.power_sd_n FROM g LEFT JOIN h ON g.level = h.level AND g.scenario IS NOT DISTINCT FROM h.scenario AND g.method IS NOT DISTINCT FROM h.method AND g.fit IS NOT DISTINCT FROM h.fit"""


@query("a21_method_rates", _RATES)
def a21_rates(spark, d):
    """Every order stands for a run."""
    o = sp.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("scenario"), F.col("o_orderstatus").alias("method"))
    k, c = F.col("k"), F.col("c")
    own = o.withColumn("fit", F.concat(F.lit("fit"), (c % 3).cast("string"))).withColumn("completed", (k % 7 != 0) & ~((F.col("scenario") == "1-URGENT") & (c % 4 != 0)))
    runs = own.select(
        "scenario", "method", "fit", "completed", F.when(F.col("completed"), 0).otherwise(c % 3).alias("n_blockers"), F.when(~F.col("completed") & (k % 5 == 0), "failed").alias("error"),
        F.when(c % 10 == 0, "ridge").when(c % 10 == 1, "").alias("fallback"), (c % 97 / 970).alias("power_zero"), F.when(k % 11 != 0, k % 1000 / 1000).alias("power"), (c % 1000 / 1000).alias("reference"),
        (k % 60 / 10 + 0.5).alias("mde"), (c % 50 / 10).alias("reference_mde"), (k % 3 != 0).alias("mde_reached"), F.when(c % 13 != 0, c % 4 != 0).alias("reference_reached"), (k % 500 / 250).alias("seconds"),
    )
    expected = spark.createDataFrame([("1-URGENT", True), ("2-HIGH", True), ("3-MEDIUM", False), ("4-NOT SPECIFIED", False)], "scenario string, blocked boolean")
    return rounded(evidence.method_rates(runs, expected))


NAMES = ("corr", "r2", "smape", "mean_uplift", "prob_pos", "iterations", "trace", "n_selected")
STAGE_OF = ("counterfactual_validation", "observed_impact", "statistical_power")
RESULTS = f"SELECT l_orderkey AS experiment, list_extract({list(STAGE_OF)}, l_linenumber % 3 + 1) AS stage, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag END AS method, list_extract({list(NAMES)}, (l_suppkey % 8 + 1)::INTEGER) AS name, CASE WHEN l_partkey % 9 <> 0 THEN (l_partkey % 1000)::VARCHAR END AS value FROM lineitem"
_KEPT_SQL = " ".join(f"WHEN stage = '{s}' THEN name IN {names}" for s, names in summaries.KEPT.items())


def results(spark, d):
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    line = F.col("l_linenumber") % 3
    return sp.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("experiment"), at(STAGE_OF, line).alias("stage"), F.when(line == 0, F.col("l_returnflag")).alias("method"), at(NAMES, F.col("l_suppkey") % 8).alias("name"),
        F.when(F.col("l_partkey") % 9 != 0, (F.col("l_partkey") % 1000).cast("string")).alias("value"),
    )


@query("d13_result_summaries", f"WITH r AS ({RESULTS}), k AS (SELECT experiment, stage, method, name, MAX(value) AS value FROM r WHERE CASE {_KEPT_SQL} ELSE true END GROUP BY ALL) SELECT experiment, stage, method, string_agg(name || '=' || COALESCE(value, 'null'), ',' ORDER BY name) AS summary FROM k GROUP BY 1, 2, 3")
def d13_results(spark, d):
    s = summaries.result_summaries(results(spark, d))
    text = F.array_join(F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ",")
    return s.select("experiment", "stage", "method", text.alias("summary"))


VERSIONS = "v AS (SELECT o_custkey AS experiment, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 5 + 1 END AS version, o_orderdate::DATE AS frozen_at, md5(o_orderkey::VARCHAR) AS fingerprint FROM orders WHERE o_orderstatus = 'F')"


def versions(spark, d):
    k = F.col("o_orderkey")
    return sp.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("experiment"), F.when(k % 6 != 0, k % 5 + 1).alias("version"), F.col("o_orderdate").cast("date").alias("frozen_at"), F.md5(k.cast("string").cast("binary")).alias("fingerprint"))


_STATE = f"CASE WHEN a.version IS NOT NULL THEN '{summaries.FROZEN}' WHEN c_acctbal > 3000 THEN '{summaries.RECOMMENDED}' ELSE '{summaries.PLANNING}' END"


@query("d13_stakeholder_summaries", f"""WITH {VERSIONS}, a AS (SELECT experiment, MAX(version) AS version FROM v GROUP BY 1), x AS (SELECT customer.*, a.version, {_STATE} AS approval, c_acctbal > 3000 AS rec FROM customer LEFT JOIN a ON a.experiment = c_custkey)
SELECT c_custkey AS experiment, approval, version AS active_version, CASE WHEN rec AND c_nationkey % 4 <> 0 THEN 'status ' || c_nationkey % 4 ELSE 'not_supplied' END AS recommendation, CASE WHEN rec THEN 's' || c_nationkey END AS selected_scenario, CASE WHEN rec AND c_nationkey % 2 = 1 THEN 'power,cost' ELSE '' END AS limiting_factors, rec AND c_custkey % 5 = 0 AS override_applied,
c_custkey % 3 = 0 AS source_embedded, CASE c_custkey % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'hash_only' ELSE 'not_recorded' END AS source_status, CASE approval {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in summaries.NEXT.items())} END AS next_action FROM x""")
def d13_stakeholders(spark, d):
    c = sp.table(spark, d, "customer").withColumnRenamed("c_custkey", "experiment")
    n, k = F.col("c_nationkey"), F.col("experiment")
    rec = c.where("c_acctbal > 3000").select(
        "experiment", F.when(n % 4 != 0, F.concat(F.lit("status "), (n % 4).cast("string"))).otherwise("").alias("status"), F.concat(F.lit("s"), n.cast("string")).alias("scenario"),
        F.when(n % 2 == 1, F.array(F.lit("power"), F.lit("cost"))).alias("limiting"), F.when(k % 5 == 0, True).alias("overridden"),
    )
    src = c.where(k % 3 != 2).select("experiment", (k % 3 == 0).alias("embedded"), F.when(k % 3 == 0, "available").otherwise("hash_only").alias("status"))
    s = summaries.stakeholder_summaries(c.select("experiment"), versions(spark, d), rec, src)
    return s.withColumn("limiting_factors", F.array_join("limiting_factors", ","))


@query("d13_technical_summaries", f"""WITH {VERSIONS}, f AS (SELECT experiment, version, arg_max(frozen_at, fingerprint) AS frozen_at, MAX(fingerprint) AS fingerprint FROM v WHERE version IS NOT NULL GROUP BY 1, 2), g AS (SELECT experiment, string_agg(version || '@' || frozen_at || ':' || fingerprint, ',' ORDER BY version) AS frozen, MAX(version) AS active_version FROM f GROUP BY 1),
s AS (SELECT c_custkey AS experiment, stage, CASE WHEN k > c_nationkey % 3 THEN 'not_started' ELSE 'completed' END AS status, k = 1 AND c_acctbal < 0 AS stale FROM customer, (VALUES ('match', 0), ('power', 1), ('validation', 2)) AS t(stage, k)),
st AS (SELECT experiment, string_agg(stage || ':' || status, ',' ORDER BY stage) AS stages, COALESCE(string_agg(stage, ',' ORDER BY stage) FILTER (stale), '') AS stale_stages FROM s GROUP BY 1), r AS (SELECT experiment, string_agg(DISTINCT stage, ',' ORDER BY stage) AS result_stages FROM ({RESULTS}) GROUP BY 1)
SELECT experiment, stages, stale_stages, COALESCE(frozen, '') AS frozen_versions, active_version, COALESCE(result_stages, '') AS result_stages FROM st LEFT JOIN g USING (experiment) LEFT JOIN r USING (experiment)""")
def d13_technical(spark, d):
    c = sp.table(spark, d, "customer").select("*", F.posexplode(F.array(*map(F.lit, ("match", "power", "validation")))).alias("k", "stage"))
    stages = c.select(F.col("c_custkey").alias("experiment"), "stage", F.when(F.col("k") > F.col("c_nationkey") % 3, "not_started").otherwise("completed").alias("status"), ((F.col("k") == 1) & (F.col("c_acctbal") < 0)).alias("stale"), F.lit(None).cast("string").alias("fingerprint"))
    t = summaries.technical_summaries(stages, versions(spark, d), results(spark, d))
    one = lambda v: F.concat(v["version"].cast("string"), F.lit("@"), v["frozen_at"].cast("string"), F.lit(":"), v["fingerprint"])
    return t.select(
        "experiment", F.array_join(F.transform("stages", lambda s: F.concat(s["stage"], F.lit(":"), s["status"])), ",").alias("stages"), F.array_join("stale_stages", ",").alias("stale_stages"),
        F.array_join(F.transform("frozen_versions", one), ",").alias("frozen_versions"), F.col("active_version.version").alias("active_version"), F.array_join("result_stages", ",").alias("result_stages"),
    )


@query("m13_match_results", f"""WITH {LONGF}, {STATS}, {TEST_SQL}, tp AS (SELECT feature, SUM(value * population) / SUM(population) AS t FROM lf SEMI JOIN t USING (region) GROUP BY 1), pool AS (SELECT DISTINCT region FROM lf ANTI JOIN t USING (region)),
g AS (SELECT 'pairs' AS strategy, region AS a, other AS b FROM pool, (SELECT region AS other FROM pool) WHERE region < other UNION ALL SELECT 'single', region, region FROM pool), m AS (SELECT strategy, a || '+' || b AS group_id, UNNEST(list_distinct([a, b])) AS region FROM g),
cp AS (SELECT strategy, group_id, feature, SUM(value * population) / SUM(population) AS c FROM m JOIN lf USING (region) GROUP BY 1, 2, 3), z AS (SELECT *, (t - c) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS e, CASE WHEN sd > 0 THEN ABS(t - c) / sd END AS smd FROM cp JOIN tp USING (feature) JOIN st USING (feature)),
sc AS (SELECT strategy, group_id, SQRT(SUM(e * e)) AS distance, AVG(smd) AS mean_abs_smd, string_agg(feature || ':' || COALESCE(printf('%.3f', smd), 'none'), ',' ORDER BY feature) AS smds FROM z GROUP BY 1, 2), w AS (SELECT *, MIN(distance) OVER (PARTITION BY strategy ORDER BY group_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM sc)
SELECT strategy, (SELECT string_agg(region, ',' ORDER BY region) FROM m WHERE m.strategy = w.strategy AND m.group_id = arg_min(w.group_id, w.distance)) AS controls, ROUND(MIN(distance), 4) AS distance, ROUND(arg_min(mean_abs_smd, distance), 4) AS mean_abs_smd, arg_min(smds, distance) AS smds, COUNT(*) AS candidates,
string_agg(printf('%.3f', distance), ',' ORDER BY group_id DESC) FILTER (so_far IS NULL OR distance < so_far) AS convergence FROM w GROUP BY strategy""")
def m13(spark, d):
    """Two strategies: single regions, and all pairs, tried from the last label to the first."""
    long, test = long_features(spark, d), test_regions(spark, d)
    pool = long.select("region").distinct().join(test, "region", "left_anti")
    pairs = pool.join(pool.select(F.col("region").alias("b")), F.col("region") < F.col("b")).select(F.lit("pairs").alias("strategy"), F.col("region").alias("a"), "b")  # the candidates themselves
    both = pairs.unionByName(pool.select(F.lit("single").alias("strategy"), F.col("region").alias("a"), F.col("region").alias("b")))
    rank = matching.member_numbers(long).withColumnRenamed("region", "a"), matching.member_numbers(long).select(F.col("region").alias("b"), F.col("number").alias("second"))
    placed = both.join(rank[0], "a").join(rank[1], "b").select("strategy", (-1000 * F.col("number") - F.col("second")).alias("place"), F.concat("a", F.lit("+"), "b").alias("group_id"), F.explode(F.array_distinct(F.array("a", "b"))).alias("region"))
    out = matching.match_results(placed, long, test)
    text = lambda c: F.when(c.isNull(), "none").otherwise(F.format_string("%.3f", c))
    out = out.withColumn("controls", F.array_join("controls", ",")).withColumn("smds", F.array_join(F.transform("smds", lambda s: F.concat(s["feature"], F.lit(":"), text(s["abs_smd"]))), ",")).withColumn("convergence", F.array_join(F.transform("convergence", text), ","))
    return rounded(out.drop("seed"))
