"""The registered queries of the experiment engine, and their DuckDB SQL where SQL can express them.

Results are rounded where the order of floating-point sums could change the last digits.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.functions import columns as fc
from quadrat.operators import bayes, decisions, evidence, ingest, mapping, matching, power, records, validation
from quadrat.plans import sizing
from quadrat.sources import catalogue, sinks, synthetic
from quadrat.sources import panel as sp
from quadrat.streaming import panel_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

WEEKS = "SELECT trim(r_name) AS region, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS kpi, COUNT(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"
MONTHS = "SELECT trim(n_name) AS region, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS kpi, COUNT(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"
DAYS = "SELECT event_type AS region, CAST(ts AS DATE) AS date, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS kpi, COUNT(*) AS n FROM events GROUP BY 1, 2"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
FEATURES = ["mean_balance", "suppliers", *(f"share_{s.lower()}" for s in SEGMENTS)]
DEMOGRAPHICS = f"""SELECT trim(n_name) AS region, n_regionkey, CAST(p AS DOUBLE) AS Population, mean_balance, CAST(s AS DOUBLE) AS suppliers, {', '.join(f'share_{s.lower()}' for s in SEGMENTS)}
FROM (SELECT c_nationkey, COUNT(*) AS p, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS mean_balance, {', '.join(f"CAST(COUNT(*) FILTER (c_mktsegment = '{s}') AS DOUBLE) / COUNT(*) AS share_{s.lower()}" for s in SEGMENTS)} FROM customer GROUP BY 1)
JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, COUNT(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey"""
#: Fixed dates of the wide frames.
WIDE = [date(1996, m, 1) for m in range(1, 13)]
PRE_END = "1999-12-31"
HORIZON = 8


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def weeks(spark: SparkSession, d: str) -> DataFrame:
    return sp.order_panel(spark, d, "region", "week").select("region", "date", F.col("revenue").alias("kpi"), "orders")


def months(spark: SparkSession, d: str) -> DataFrame:
    return sp.order_panel(spark, d, "nation", "month").select("region", "date", F.col("revenue").alias("kpi"), "orders")


def r(c: Column | str, n: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def rounded(df: DataFrame, n: int = 4) -> DataFrame:
    return df.select(*(r(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def wide_months(spark: SparkSession, d: str) -> DataFrame:
    """A wide source frame: Region, Metric and a column of text for each of twelve months; some cells are broken on purpose."""
    p = months(spark, d).where(F.col("date").isin(WIDE))
    cells = ingest.to_wide(p, WIDE)
    bad = F.when(F.length("region") % 5 == 0, F.lit("n/a"))
    last = WIDE[-1].isoformat()
    return cells.select(F.col("region").alias("Region"), F.lit(" Revenue ").alias("Metric"), *(F.col(f"`{x}`").cast("decimal(20,2)").cast("string").alias(x.isoformat()) for x in WIDE[:-1]), F.coalesce(bad, F.col(f"`{last}`").cast("decimal(20,2)").cast("string")).alias(last))


LONG = f"""WITH m AS ({MONTHS}), regions AS (SELECT DISTINCT region FROM m WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-01'),
dates AS (SELECT UNNEST(generate_series(DATE '1996-01-01', DATE '1996-12-01', INTERVAL 1 MONTH))::DATE AS date),
long AS (SELECT regions.region, dates.date, CASE WHEN dates.date = DATE '1996-12-01' AND length(regions.region) % 5 = 0 THEN 'n/a' ELSE CAST(CAST(kpi AS DECIMAL(20,2)) AS VARCHAR) END AS raw FROM regions CROSS JOIN dates LEFT JOIN m ON m.region = regions.region AND m.date = dates.date)"""


def long_months(spark: SparkSession, d: str) -> DataFrame:
    w = wide_months(spark, d)
    return ingest.melt(w, ingest.resolve_layout(w.columns))


# panel

@query("a1_canonical_panel", f"{WEEKS}")
def a1(spark, d):
    return weeks(spark, d)


@query("a2_geo_aggregate", f"SELECT date, COALESCE(SUM(n), 0)::BIGINT AS n, ROUND(COALESCE(SUM(kpi), 0), 4) AS kpi FROM ({DAYS}) GROUP BY 1")
def a2(spark, d):
    return sp.event_panel(spark, d).groupBy("date").agg(F.sum("n").alias("n"), r(F.coalesce(F.sum("kpi"), F.lit(0.0))).alias("kpi"))


@query("r1_melt", f"{LONG} SELECT region AS region_raw, 'Revenue' AS metric_name, strftime(date, '%Y-%m-%d') AS date_raw, raw AS kpi_raw FROM long")
def r1(spark, d):
    return long_months(spark, d)


@query("r2_pivot", f"SELECT region, {', '.join(f'''MAX(kpi) FILTER (date = DATE '{x}') AS m{x.month}''' for x in WIDE)} FROM ({MONTHS}) WHERE year(date) = 1996 GROUP BY 1")
def r2(spark, d):
    own = ingest.to_wide(ingest.require_unique(months(spark, d).where(F.year("date") == 1996), ["region", "date"]), WIDE)
    return own.select("region", *(F.col(f"`{x}`").alias(f"m{x.month}") for x in WIDE))


@query("p11_rejects", f"{LONG} SELECT region AS region_raw, 'Revenue' AS metric_name, strftime(date, '%Y-%m-%d') AS date_raw, raw AS kpi_raw, CASE WHEN raw IS NULL THEN 'missing value' ELSE 'non-numeric value' END AS reject FROM long WHERE raw IS NULL OR TRY_CAST(raw AS DOUBLE) IS NULL")
def p11(spark, d):
    return ingest.rejects(long_months(spark, d))


@query("s2_canonical_of_wide", f"{LONG} SELECT region, date, 'revenue' AS metric, TRY_CAST(raw AS DOUBLE) AS kpi, 1::BIGINT AS source_row_count FROM long")
def s2(spark, d):
    return ingest.canonical(long_months(spark, d)).select("region", "date", "metric", "kpi", "source_row_count")


@query("a7_quality_report", f"""{LONG} SELECT COUNT(*) AS n_cells, COUNT(*) FILTER (raw IS NULL) AS n_missing, COUNT(*) FILTER (raw IS NOT NULL AND TRY_CAST(raw AS DOUBLE) IS NULL) AS n_non_numeric,
COUNT(*) FILTER (TRY_CAST(raw AS DOUBLE) = 0) AS n_zero, COUNT(*) FILTER (TRY_CAST(raw AS DOUBLE) IS NOT NULL) AS n_retained, COUNT(DISTINCT region) AS n_regions, COUNT(DISTINCT date) AS n_dates, MIN(date) AS first_date, MAX(date) AS last_date FROM long""")
def a7(spark, d):
    return ingest.quality_report(long_months(spark, d)).select("n_cells", "n_missing", "n_non_numeric", "n_zero", "n_retained", "n_regions", "n_dates", "first_date", "last_date")


@query("a8_duplicate_keys", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, COUNT(*) AS n_rows FROM orders GROUP BY 1, 2 HAVING COUNT(*) > 1")
def a8(spark, d):
    return ingest.duplicate_keys(sp.table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date")), ["o_custkey", "date"])


@query("a6_period_quality", f"""WITH m AS ({MONTHS}), q AS (SELECT date, COUNT(kpi) AS observed, COUNT(*) FILTER (kpi = 0) AS zeros, SUM(kpi) AS total FROM m GROUP BY 1), e AS (SELECT COUNT(DISTINCT region) AS expected FROM m)
SELECT date, expected, observed, ROUND(observed / expected, 6) AS coverage, zeros, ROUND(zeros / observed, 6) AS zero_share, ROUND(total, 2) AS total,
CASE WHEN observed / expected < 0.5 THEN 'missing_market_wide_period' WHEN observed / expected >= 0.9 AND zeros = observed THEN 'definite_market_wide_zero' WHEN zeros / observed >= 0.8 THEN 'possible_widespread_outage' ELSE 'normal' END AS period_class FROM q, e""")
def a6(spark, d):
    q = ingest.period_quality(months(spark, d))
    return q.select("date", "expected", "observed", r("coverage", 6).alias("coverage"), "zeros", r("zero_share", 6).alias("zero_share"), r("total", 2).alias("total"), "period_class")


@query("w2_median_cadence", f"""WITH g AS (SELECT region, date, datediff('day', LAG(date) OVER (PARTITION BY region ORDER BY date), date) AS gap FROM ({WEEKS})), s AS (SELECT region, COUNT(*) AS n_dates, median(gap) AS median_gap FROM g GROUP BY 1)
SELECT s.region, n_dates, median_gap, CASE WHEN median_gap BETWEEN 0.5 AND 1.5 THEN 'daily' WHEN median_gap BETWEEN 5.5 AND 8.5 THEN 'weekly' ELSE 'unknown' END AS median_cadence, COALESCE(bool_and(gap = median_gap), true) AS contiguous, COUNT(*) FILTER (gap > 1.5 * median_gap)::INTEGER AS n_breaks FROM s JOIN g USING (region) GROUP BY ALL""")
def w2(spark, d):
    return ingest.cadence(weeks(spark, d), ["region"]).select("region", "n_dates", "median_gap", "median_cadence", "contiguous", "n_breaks")


@query("w1_gcd_cadence", f"""WITH RECURSIVE g AS (SELECT region, datediff('day', LAG(date) OVER (PARTITION BY region ORDER BY date), date) AS gap FROM ({DAYS})), u AS (SELECT DISTINCT region, gap FROM g WHERE gap IS NOT NULL), o AS (SELECT region, gap, row_number() OVER (PARTITION BY region ORDER BY gap) AS k FROM u),
f AS (SELECT region, k, gap AS v FROM o WHERE k = 1 UNION ALL SELECT o.region, o.k, gcd(f.v, o.gap) FROM f JOIN o ON o.region = f.region AND o.k = f.k + 1)
SELECT region, arg_max(v, k)::INTEGER AS gcd_gap, CASE WHEN arg_max(v, k) = 1 THEN 'daily' WHEN arg_max(v, k) BETWEEN 6 AND 8 THEN 'weekly' ELSE 'unknown' END AS gcd_cadence FROM f GROUP BY 1""")
def w1(spark, d):
    return ingest.cadence(sp.event_panel(spark, d), ["region"]).select("region", F.col("gcd_gap").cast("int").alias("gcd_gap"), "gcd_cadence")


@query("j7_missing_dates", f"""WITH m AS ({MONTHS.replace("'month'", "'week'")}), s AS (SELECT region, MIN(date) AS lo, MAX(date) AS hi FROM m GROUP BY 1), e AS (SELECT region, UNNEST(generate_series(lo, hi, INTERVAL 7 DAY))::DATE AS date FROM s) SELECT region, date FROM e ANTI JOIN m USING (region, date)""")
def j7(spark, d):
    return ingest.missing_dates(sp.order_panel(spark, d, "nation", "week"), ["region"])


@query("f23_fingerprint")
def f23(spark, d):
    return ingest.fingerprint(months(spark, d))


@query("w5_source_positions", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS position FROM orders")
def w5(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return sp.table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("position"))


# mapping

def raw_panel(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose labels are nations with noise: odd nations in another case, every seventh renamed."""
    n = sp.table(spark, d, "nation").select("n_nationkey", F.trim("n_name").alias("n"))
    label = F.when(F.col("n_nationkey") % 7 == 3, F.concat(F.lit(" Zone "), "n_nationkey")).when(F.col("n_nationkey") % 2 == 1, F.lower("n")).otherwise(F.concat("n", F.lit(" ")))
    c = sp.table(spark, d, "customer").groupBy("c_nationkey").count()
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(label.alias("region_raw"), F.col("count").alias("kpi"))


def region_map(spark: SparkSession, d: str) -> DataFrame:
    n = sp.table(spark, d, "nation").select("n_nationkey", F.trim("n_name").alias("n"))
    own = n.where("n_nationkey % 2 = 1 and n_nationkey % 7 != 3").select(F.lower("n").alias("label"), F.col("n").alias("region"), F.col("n_nationkey").alias("position"))
    return own.unionByName(own.select("label", F.lit("NOWHERE").alias("region"), (F.col("position") - 100).alias("position")))


RAW = "raw AS (SELECT CASE WHEN n_nationkey % 7 = 3 THEN 'Zone ' || n_nationkey WHEN n_nationkey % 2 = 1 THEN lower(trim(n_name)) ELSE trim(n_name) END AS label, CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE trim(n_name) END AS region, k FROM nation JOIN (SELECT c_nationkey, COUNT(*) AS k FROM customer GROUP BY 1) ON c_nationkey = n_nationkey)"


@query("j3_region_mapping", f"WITH {RAW} SELECT label, region, k AS kpi FROM raw")
def j3(spark, d):
    universe = sp.table(spark, d, "nation").select(F.trim("n_name").alias("region"))
    return mapping.map_regions(raw_panel(spark, d), universe, region_map(spark, d)).select(F.trim("region_raw").alias("label"), "region", "kpi")


@query("j19_mapping_report", f"WITH {RAW} SELECT COUNT(DISTINCT label) AS labels, COUNT(DISTINCT label) FILTER (region IS NULL) AS unmapped_labels, COUNT(*) AS n_rows, COUNT(*) FILTER (region IS NULL) AS unmapped_rows, COUNT(DISTINCT region) AS covered, COALESCE(string_agg(DISTINCT label, ', ' ORDER BY label) FILTER (region IS NULL), '') AS unmapped_list, (SELECT COUNT(*) FROM nation) AS universe FROM raw")
def j19(spark, d):
    universe = sp.table(spark, d, "nation").select(F.trim("n_name").alias("region"))
    mapped = mapping.map_regions(raw_panel(spark, d).withColumn("region_raw", F.trim("region_raw")), universe, region_map(spark, d))
    return mapping.mapping_report(mapped, universe)


@query("j5_uncovered_regions", f"WITH {RAW} SELECT trim(n_name) AS region FROM nation WHERE trim(n_name) NOT IN (SELECT region FROM raw WHERE region IS NOT NULL)")
def j5(spark, d):
    universe = sp.table(spark, d, "nation").select(F.trim("n_name").alias("region"))
    return mapping.uncovered(universe, mapping.map_regions(raw_panel(spark, d), universe, region_map(spark, d)))


# matching

def features(spark: SparkSession, d: str) -> DataFrame:
    """Imputed features of all nations."""
    return matching.impute(sp.demographics(spark, d), FEATURES)


IMPUTED = f"demo AS ({DEMOGRAPHICS}), feat AS (SELECT region, n_regionkey, Population AS population, {', '.join(f'COALESCE({f}, (SELECT median({f}) FROM demo), 0.0) AS {f}' for f in FEATURES)} FROM demo)"
LONGF = f"{IMPUTED}, lf AS (UNPIVOT feat ON {', '.join(FEATURES)} INTO NAME feature VALUE value)"
STATS = "st AS (SELECT feature, AVG(value) AS mu, stddev_pop(value) AS sd FROM lf GROUP BY 1)"
TESTS = ("NATION_1", "NATION_2")


def long_features(spark: SparkSession, d: str) -> DataFrame:
    return matching.long_features(features(spark, d).withColumnRenamed("Population", "population"), FEATURES, ["region", "population"])


def test_regions(spark: SparkSession, d: str) -> DataFrame:
    """Two regions under test: those of nation keys 1 and 2."""
    return sp.table(spark, d, "nation").where("n_nationkey in (1, 2)").select(F.trim("n_name").alias("region"))


TEST_SQL = "t AS (SELECT trim(n_name) AS region FROM nation WHERE n_nationkey IN (1, 2))"


@query("a4_weighted_means", f"WITH demo AS ({DEMOGRAPHICS}) SELECT n_regionkey, SUM(Population) AS Population, {', '.join(f'ROUND(SUM({f} * Population) FILTER ({f} IS NOT NULL) / NULLIF(SUM(Population) FILTER ({f} IS NOT NULL), 0), 6) AS {f}' for f in FEATURES)} FROM demo GROUP BY 1")
def a4(spark, d):
    return rounded(matching.weighted_means(sp.demographics(spark, d), ["n_regionkey"], FEATURES, "Population"), 6)


@query("a11_weighted_profile", f"WITH {IMPUTED} SELECT {', '.join(f'ROUND(SUM({f} * population) / SUM(population), 6) AS {f}' for f in FEATURES)} FROM feat")
def a11(spark, d):
    return rounded(matching.profile(features(spark, d), FEATURES, "Population"), 6)


@query("m11_impute", f"WITH {IMPUTED} SELECT region, population AS Population, {', '.join(f'ROUND({f}, 6) AS {f}' for f in FEATURES)} FROM feat")
def m11(spark, d):
    return rounded(features(spark, d).select("region", "Population", *FEATURES), 6)


@query("a10_structural_stats", f"WITH {LONGF}, {STATS} SELECT feature, ROUND(mu, 6) AS mu, ROUND(sd, 6) AS sd FROM st")
def a10(spark, d):
    return rounded(matching.structural_stats(long_features(spark, d)), 6)


GROUPS = f"""WITH {LONGF}, {STATS}, {TEST_SQL}, tp AS (SELECT feature, SUM(value * population) / SUM(population) AS t FROM lf SEMI JOIN t USING (region) GROUP BY 1),
cp AS (SELECT region AS group_id, feature, value AS c FROM lf ANTI JOIN t USING (region)),
sc AS (SELECT group_id, SQRT(SUM(POWER((t - c) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 2))) AS distance, AVG(CASE WHEN sd > 0 THEN ABS(t - c) / sd END) AS mean_abs_smd FROM cp JOIN tp USING (feature) JOIN st USING (feature) GROUP BY 1)"""


@query("m1_score_groups", f"{GROUPS} SELECT group_id, ROUND(distance, 4) AS distance, ROUND(mean_abs_smd, 4) AS mean_abs_smd FROM sc")
def m1(spark, d):
    long, test = long_features(spark, d), test_regions(spark, d)
    pool = long.select("region").distinct().join(test, "region", "left_anti")
    return rounded(matching.score_groups(pool.select(F.col("region").alias("group_id"), "region"), long, test))


@query("m4_nearest", f"{GROUPS} SELECT group_id, ROUND(distance, 4) AS distance, ROUND(mean_abs_smd, 4) AS mean_abs_smd FROM sc ORDER BY sc.distance, group_id LIMIT 6")
def m4(spark, d):
    return rounded(matching.nearest(long_features(spark, d), test_regions(spark, d), 6))


@query("m12_balance_table", f"""WITH {LONGF}, {STATS}, {TEST_SQL}, tp AS (SELECT feature, SUM(value * population) / SUM(population) AS test_mean FROM lf SEMI JOIN t USING (region) GROUP BY 1), cp AS (SELECT feature, SUM(value * population) / SUM(population) AS control_mean FROM lf ANTI JOIN t USING (region) GROUP BY 1)
SELECT feature, ROUND(test_mean, 4) AS test_mean, ROUND(control_mean, 4) AS control_mean, ROUND(test_mean - control_mean, 4) AS difference, ROUND(CASE WHEN sd > 0 THEN ABS(test_mean - control_mean) / sd END, 4) AS abs_smd, ROUND(POWER((test_mean - control_mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 2), 4) AS contribution FROM tp JOIN cp USING (feature) JOIN st USING (feature)""")
def m12(spark, d):
    long, test = long_features(spark, d), test_regions(spark, d)
    return rounded(matching.balance_table(long, test, long.select("region").distinct().join(test, "region", "left_anti")))


@query("w16_index_to_100", f"SELECT region, date, ROUND(kpi / AVG(kpi) OVER (PARTITION BY region) * 100, 4) AS indexed FROM ({WEEKS})")
def w16(spark, d):
    return matching.index_to_100(weeks(spark, d)).select("region", "date", r("indexed").alias("indexed"))


@query("m10_retained_regions", f"WITH m AS ({MONTHS}) SELECT region, ROUND(SUM(kpi), 2) AS volume FROM m GROUP BY 1 HAVING COUNT(kpi) = (SELECT COUNT(DISTINCT date) FROM m) AND SUM(kpi) > 0")
def m10(spark, d):
    return rounded(matching.retained_regions(months(spark, d)), 2)


def populations(spark: SparkSession, d: str) -> DataFrame:
    return sp.demographics(spark, d).select("region", F.col("Population").alias("population"))


@query("m8_guided_test_group", f"""WITH demo AS ({DEMOGRAPHICS}), p AS (SELECT region, SUM(Population)::DOUBLE AS p FROM demo GROUP BY 1), tot AS (SELECT SUM(p) AS total, COUNT(*) AS n FROM p),
draws AS (SELECT s, region, p, row_number() OVER (PARTITION BY s ORDER BY ('0x' || substr(md5('0:' || s || ':' || region), 1, 8))::BIGINT, region) AS place, ('0x' || substr(md5('0:' || s), 1, 8))::BIGINT % (n + 1) AS size FROM (SELECT UNNEST(range(2000)) AS s), p, tot),
g AS (SELECT SUM(p ORDER BY region) / (SELECT total FROM tot) AS share, list(region ORDER BY region) AS grp FROM draws WHERE place <= size GROUP BY s UNION ALL SELECT 0.0, []),
d AS (SELECT *, CASE WHEN share BETWEEN 0.27 AND 0.33 THEN 0 ELSE LEAST(ABS(share - 0.27), ABS(share - 0.33)) END AS dist FROM g)
SELECT array_to_string(grp, ', ') AS test_group, ROUND(share, 6) AS share, share BETWEEN 0.27 AND 0.33 AS met FROM d ORDER BY dist, ABS(share - 0.3), len(grp), grp LIMIT 1""")
def m8(spark, d):
    return rounded(matching.guided_test_group(populations(spark, d), 30.0, 3.0), 6)




ASSIGNED = ("exclude_from_both", "force_test_include", "force_control_include", "test_only_exclude", "control_only_exclude")


@query("m9_constraint_conflicts", f"""WITH f AS (SELECT c_custkey // 3 AS region, list_extract({list(ASSIGNED)}, c_nationkey % 5 + 1) AS field FROM customer), g AS (SELECT region, list(DISTINCT field ORDER BY field) AS fs FROM f GROUP BY 1)
SELECT region, array_to_string(fs, ',') AS fields FROM g WHERE (list_contains(fs, 'exclude_from_both') AND len(fs) > 1) OR list_has_all(fs, ['force_test_include', 'force_control_include']) OR list_has_all(fs, ['force_test_include', 'test_only_exclude']) OR list_has_all(fs, ['force_control_include', 'control_only_exclude'])""")
def m9(spark, d):
    """Three customers stand for the assignments of a region."""
    c = sp.table(spark, d, "customer")
    return matching.constraint_conflicts(c.select(F.floor(F.col("c_custkey") / 3).alias("region"), F.element_at(F.array(*map(F.lit, ASSIGNED)), (F.col("c_nationkey") % 5 + 1).cast("int")).alias("field")))


@query("m5_hill_climb_sweep")
def m5(spark, d):
    f, test = features(spark, d).withColumnRenamed("Population", "population"), test_regions(spark, d)
    return matching.pool_sweep(spark, f.join(test, "region", "left_anti"), f.join(test, "region", "left_semi"), FEATURES, [2, 3, 4, 6, 8])


@query("m6_stochastic_sweep")
def m6(spark, d):
    f, test = features(spark, d).withColumnRenamed("Population", "population"), test_regions(spark, d)
    return matching.pool_sweep(spark, f.join(test, "region", "left_anti"), f.join(test, "region", "left_semi"), FEATURES, [2, 3, 4, 6, 8], "stochastic")


@query("o7_best_pool_size")
def o7(spark, d):
    return m5(spark, d).where("distance is not null").agg(F.min_by(F.struct("n", "distance", "group"), F.struct("distance", "n")).alias("x")).select("x.*")


# validation

def region_names(spark: SparkSession, d: str) -> tuple[list[str], list[str]]:
    """The first region by key is under test, the rest are controls: five rows."""
    names = [x[0] for x in sp.table(spark, d, "region").orderBy("r_regionkey").select(F.trim("r_name")).collect()]
    return names[:1], names[1:]


LAGGED = f"WITH w AS ({WEEKS})"


@query("j2_calendar_lags", f"{LAGGED} SELECT w.region, w.date, l.lag, s.kpi FROM w CROSS JOIN (VALUES (1), (4)) AS l(lag) JOIN w AS s ON s.region = w.region AND s.date = w.date - l.lag * 7")
def j2(spark, d):
    return validation.calendar_lags(weeks(spark, d), [1, 4], 7)


@query("r4_model_matrix", f"""{LAGGED}, n AS (SELECT trim(r_name) AS region, row_number() OVER (ORDER BY r_regionkey) AS k FROM region), x AS (SELECT date, {', '.join(f'SUM(kpi) FILTER (k = {k}) AS v{k}' for k in range(1, 6))} FROM w JOIN n USING (region) GROUP BY 1) SELECT date, v1 AS test_kpi, v2, v3, v4, v5 FROM x WHERE v1 IS NOT NULL AND v2 IS NOT NULL AND v3 IS NOT NULL AND v4 IS NOT NULL AND v5 IS NOT NULL""")
def r4(spark, d):
    t, c = region_names(spark, d)
    m = validation.model_matrix(weeks(spark, d), t, c)
    return m.select("date", "test_kpi", *(F.col(f"`{x}`").alias(f"v{k + 2}") for k, x in enumerate(c)))


@query("a3_test_series", f"{LAGGED} SELECT date, SUM(kpi) AS test_kpi FROM w WHERE region IN (SELECT trim(r_name) FROM region ORDER BY r_regionkey LIMIT 1) GROUP BY 1")
def a3(spark, d):
    return validation.test_series(weeks(spark, d), region_names(spark, d)[0])


PAIRS = f"""{LAGGED}, pairs AS (SELECT w.region, w.date, w.kpi AS actual, s.kpi AS predicted FROM w JOIN w AS s ON s.region = w.region AND s.date = w.date - 7)"""


def naive_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each week against the week before, as a prediction."""
    w = weeks(spark, d)
    return w.select("region", "date", F.col("kpi").alias("actual")).join(validation.calendar_lags(w, [1], 7).select("region", "date", F.col("kpi").alias("predicted")), ["region", "date"])


@query("a16_error_metrics", f"""{PAIRS} SELECT region, ROUND(AVG(ABS(actual - predicted) / CASE WHEN ABS(actual) + ABS(predicted) = 0 THEN 1e-8 ELSE (ABS(actual) + ABS(predicted)) / 2 END) * 100, 4) AS smape, ROUND(SQRT(AVG(POWER(actual - predicted, 2))), 2) AS rmse,
ROUND(CASE WHEN var_pop(actual) > 0 THEN 1 - SUM(POWER(actual - predicted, 2)) / (var_pop(actual) * COUNT(actual)) END, 4) AS r2, ROUND(corr(actual, predicted), 4) AS correlation FROM pairs GROUP BY 1""")
def a16(spark, d):
    return validation.error_metrics(naive_pairs(spark, d), ["region"]).select("region", r("smape").alias("smape"), r("rmse", 2).alias("rmse"), r("r2").alias("r2"), r("correlation").alias("correlation"))


@query("a17_durbin_watson", f"""{PAIRS}, e AS (SELECT region, date, actual - predicted AS residual, (actual - predicted) - LAG(actual - predicted) OVER (PARTITION BY region ORDER BY date) AS step FROM pairs) SELECT region, ROUND(SUM(step * step) / SUM(residual * residual), 4) AS durbin_watson FROM e GROUP BY 1""")
def a17(spark, d):
    res = naive_pairs(spark, d).select("region", "date", (F.col("actual") - F.col("predicted")).alias("residual"))
    return rounded(validation.durbin_watson(res, ["region"]))


@query("a12_kpi_summary", f"""WITH m AS ({MONTHS}), s AS (SELECT region, SUM(kpi) AS total, AVG(kpi) AS mean_kpi, stddev_samp(kpi) AS sd FROM m GROUP BY 1) SELECT region, ROUND(total, 2) AS total, ROUND(total / SUM(total) OVER () * 100, 4) AS share_pct, ROUND(mean_kpi, 2) AS mean_kpi, ROUND(sd / mean_kpi, 4) AS cv, CASE WHEN sd / mean_kpi < 0.2 THEN 'low' WHEN sd / mean_kpi < 0.5 THEN 'moderate' ELSE 'high' END AS volatility FROM s""")
def a12(spark, d):
    s = months(spark, d).groupBy("region").agg(F.sum("kpi").alias("total"), F.avg("kpi").alias("mean_kpi"), F.stddev_samp("kpi").alias("sd"))
    cv = F.col("sd") / F.col("mean_kpi")
    return s.select("region", r("total", 2).alias("total"), r(F.col("total") / F.sum("total").over(Window.partitionBy()) * 100).alias("share_pct"), r("mean_kpi", 2).alias("mean_kpi"), r(cv).alias("cv"), F.when(cv < 0.2, "low").when(cv < 0.5, "moderate").otherwise("high").alias("volatility"))


FITTED = f"""{LAGGED}, fitted AS (SELECT w.date, w.kpi AS actual, s.kpi AS predicted FROM w JOIN w AS s ON s.region = w.region AND s.date = w.date - 7 WHERE w.region = (SELECT trim(r_name) FROM region ORDER BY r_regionkey LIMIT 1)),
i AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i FROM fitted), pw AS (SELECT i // 4 AS bucket, COUNT(*) AS n, SUM(actual - predicted) AS uplift, SUM(actual - predicted) / SUM(predicted) * 100 AS uplift_pct FROM i GROUP BY 1 HAVING COUNT(*) = 4)"""


def fitted_naive(spark: SparkSession, d: str) -> DataFrame:
    return naive_pairs(spark, d).where(F.col("region") == region_names(spark, d)[0][0]).select("date", "actual", "predicted")


@query("w8_placebo_windows", f"{FITTED} SELECT bucket, ROUND(uplift, 2) AS uplift, ROUND(uplift_pct, 4) AS uplift_pct FROM pw")
def w8(spark, d):
    return validation.placebo_windows(fitted_naive(spark, d), 4).select("bucket", r("uplift", 2).alias("uplift"), r("uplift_pct").alias("uplift_pct"))


@query("v11_power_curve", f"""{FITTED}, thr AS (SELECT quantile_cont(uplift_pct, 0.95) AS hi, quantile_cont(uplift_pct, 0.05) AS lo, COUNT(*) AS k FROM pw), grid AS (SELECT UNNEST(range(1, 61)) * 0.5::DOUBLE AS e)
SELECT e::DOUBLE AS effect_pct, ROUND(AVG(CASE WHEN uplift_pct * (1 + e / 100) + e > hi THEN 1.0 ELSE 0.0 END), 6) AS power_lift, ROUND(AVG(CASE WHEN uplift_pct * (1 - e / 100) - e < lo THEN 1.0 ELSE 0.0 END), 6) AS power_drop FROM pw, thr, grid WHERE k >= 5 GROUP BY 1""")
def v11(spark, d):
    return rounded(validation.power_curve(validation.placebo_windows(fitted_naive(spark, d), 4)), 6)


@query("w12_first_hit_mde", f"""{FITTED}, thr AS (SELECT quantile_cont(uplift_pct, 0.95) AS hi, COUNT(*) AS k FROM pw), grid AS (SELECT UNNEST(range(1, 61)) * 0.5::DOUBLE AS e), c AS (SELECT e, AVG(CASE WHEN uplift_pct * (1 + e / 100) + e > hi THEN 1.0 ELSE 0.0 END) AS p FROM pw, thr, grid WHERE k >= 5 GROUP BY 1) SELECT MIN(e)::DOUBLE AS mde_pct FROM c WHERE p >= 0.8""")
def w12(spark, d):
    return validation.first_hit(validation.power_curve(validation.placebo_windows(fitted_naive(spark, d), 4)), "power_lift")


@query("a18_placebo_summary", f"""{FITTED}, m AS (SELECT AVG(uplift) AS m FROM pw) SELECT ROUND(quantile_cont(uplift, 0.5), 2) AS median_uplift, ROUND(quantile_cont(uplift, 0.025), 2) AS p2_5, ROUND(quantile_cont(uplift, 0.975), 2) AS p97_5, ROUND(AVG(CASE WHEN uplift < 100000.0 THEN 1.0 ELSE 0.0 END) * 100, 4) AS percentile_rank,
ROUND(AVG(CASE WHEN uplift >= 100000.0 THEN 1.0 ELSE 0.0 END), 6) AS p_one_sided, ROUND(AVG(CASE WHEN ABS(uplift - m) >= ABS(100000.0 - m) THEN 1.0 ELSE 0.0 END), 6) AS p_two_sided, ROUND((100000.0 - AVG(uplift)) / (stddev_pop(uplift) + 1e-12), 4) AS z_score, COUNT(*) AS n_placebos FROM pw, m""")
def a18(spark, d):
    s = validation.placebo_summary(validation.placebo_windows(fitted_naive(spark, d), 4), 100000.0)
    return s.select(r("median_uplift", 2).alias("median_uplift"), r("p2_5", 2).alias("p2_5"), r("p97_5", 2).alias("p97_5"), r("percentile_rank").alias("percentile_rank"), r("p_one_sided", 6).alias("p_one_sided"), r("p_two_sided", 6).alias("p_two_sided"), r("z_score").alias("z_score"), "n_placebos")


@query("v6_confidence_bands", """WITH v AS (SELECT s_suppkey::INTEGER AS case_id, (s_suppkey % 17)::DOUBLE AS pre_smape, (s_suppkey % 17 + s_nationkey % 9)::DOUBLE AS rolling_smape, (s_suppkey % 31) / 10.0::DOUBLE AS durbin_watson, (s_nationkey - 12)::DOUBLE AS bias_pct FROM supplier), b AS (SELECT case_id, CASE WHEN rolling_smape <= 10 THEN 'low' WHEN rolling_smape <= 15 THEN 'moderate' ELSE 'high' END AS e, CASE WHEN rolling_smape - pre_smape <= 3 THEN 'low' WHEN rolling_smape - pre_smape <= 5 THEN 'moderate' ELSE 'high' END AS g,
CASE WHEN durbin_watson BETWEEN 1.5 AND 2.5 THEN 'low' WHEN durbin_watson >= 1.2 AND durbin_watson < 1.5 OR durbin_watson > 2.5 AND durbin_watson <= 2.8 THEN 'moderate' ELSE 'high' END AS a, CASE WHEN ABS(bias_pct) <= 5 THEN 'low' WHEN ABS(bias_pct) <= 10 THEN 'moderate' ELSE 'high' END AS s FROM v)
SELECT case_id, e AS error_band, g AS gap_band, a AS autocorrelation_band, s AS bias_band, CASE WHEN e = 'high' THEN 'low' WHEN e = 'moderate' OR g <> 'low' OR a <> 'low' OR s <> 'low' THEN 'moderate' ELSE 'high' END AS confidence FROM b""")
def v6(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    df = sp.table(spark, d, "supplier").select(k.cast("int").alias("case_id"), (k % 17).cast("double").alias("pre_smape"), (k % 17 + n % 9).cast("double").alias("rolling_smape"), (k % 31 / 10.0).alias("durbin_watson"), (n - 12).cast("double").alias("bias_pct"))
    return validation.bands(df).select("case_id", "error_band", "gap_band", "autocorrelation_band", "bias_band", "confidence")


def matrix(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    t, c = region_names(spark, d)
    return validation.model_matrix(weeks(spark, d), t, c), c


@query("w6_rolling_origin")
def w6(spark, d):
    m, terms = matrix(spark, d)
    starts = validation.window_starts(m.count(), 13, 4, validation.MAX_FOLDS)
    return validation.fit_windows(m, terms, ["enet", "lasso"], starts, 4, "fold")


@query("a19_fold_summary")
def a19(spark, d):
    return validation.fold_summary(w6(spark, d))


@query("w7_placebo_fits")
def w7(spark, d):
    m, terms = matrix(spark, d)
    starts = validation.window_starts(m.count(), 26, HORIZON, validation.MAX_PLACEBOS)
    return validation.fit_windows(m, terms, ["lasso"], starts, HORIZON, "placebo")


@query("v4_run_validation")
def v4(spark, d):
    """One row a method: in-sample error, autocorrelation, rolling folds, and the confidence that follows."""
    m, terms = matrix(spark, d)
    folds = a19(spark, d)
    out = None
    for method in ("enet", "lasso"):
        s = validation.fit_series(m, terms, method, PRE_END)
        pre = s.where("in_pre")
        e = validation.error_metrics(pre.withColumn("method", F.lit(method)), ["method"])
        dw = validation.durbin_watson(pre.withColumn("method", F.lit(method)), ["method"])
        up = s.where("not in_pre").agg(F.sum(F.col("actual") - F.col("predicted")).alias("uplift"), (F.sum(F.col("actual") - F.col("predicted")) / F.sum("predicted") * 100).alias("uplift_pct")).withColumn("method", F.lit(method))
        one = e.join(dw, "method").join(up, "method")
        out = one if out is None else out.unionByName(one)
    x = out.withColumnRenamed("smape", "pre_smape").join(folds.select("method", F.col("smape_mean").alias("rolling_smape"), F.col("bias_pct_mean").alias("bias_pct")), "method")
    return validation.bands(x)


# power

def spine(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT explode(sequence(DATE '1995-01-02', DATE '2001-07-30', INTERVAL 7 DAY)) AS date")


@query("x1_alignment", f"""{LAGGED}, n AS (SELECT trim(r_name) AS region, row_number() OVER (ORDER BY r_regionkey) AS k FROM region), s AS (SELECT UNNEST(generate_series(DATE '1995-01-02', DATE '2001-07-30', INTERVAL 7 DAY))::DATE AS date),
g AS (SELECT date, SUM(kpi) FILTER (k = 1) AS test_kpi, COUNT(kpi) FILTER (k > 1) AS c FROM w JOIN n USING (region) GROUP BY 1) SELECT s.date, test_kpi, COALESCE(c, 0) AS n_controls, (test_kpi IS NOT NULL AND COALESCE(c, 0) = 4) AS complete FROM s LEFT JOIN g USING (date)""")
def x1(spark, d):
    t, c = region_names(spark, d)
    return power.align(weeks(spark, d), t, c, spine(spark, d)).select("date", "test_kpi", "n_controls", "complete")


@query("x1_duplicate_gate", """WITH k AS (SELECT trim(r_name) AS region, o_orderdate AS date, COUNT(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2 HAVING COUNT(*) > 1)
SELECT COUNT(*) AS n_keys, COALESCE(SUM(n), 0)::BIGINT AS n_rows, COUNT(*) > 0 AS blocked FROM k""")
def x1b(spark, d):
    """Single orders as a panel, which repeats the keys of busy days."""
    t, c = region_names(spark, d)
    own = sp.table(spark, d, "orders").join(sp.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = own.join(sp.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(sp.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return power.duplicate_gate(named.select(F.trim("r_name").alias("region"), F.col("o_orderdate").alias("date")), t + c)


NULLS = f"""{FITTED}, nulls AS (SELECT uplift AS total FROM pw), crit AS (SELECT quantile_cont(total, 0.05) AS a, quantile_cont(total, 0.95) AS b, quantile_cont(total, 0.025) AS c, quantile_cont(total, 0.975) AS e FROM nulls)"""


@query("x9_critical_values", f"{NULLS} SELECT 'one_sided_positive' AS side, NULL::DOUBLE AS lower, ROUND(b, 2) AS upper FROM crit UNION ALL SELECT 'one_sided_negative', ROUND(a, 2), NULL FROM crit UNION ALL SELECT 'two_sided', ROUND(c, 2), ROUND(e, 2) FROM crit")
def x9(spark, d):
    nulls = validation.placebo_windows(fitted_naive(spark, d), 4).select(F.col("uplift").alias("total"))
    return rounded(power.critical_values(nulls), 2)


@query("x9_detection_power", f"""{NULLS}, eff AS (SELECT UNNEST([0.0, 50000.0, 200000.0]) AS e2), alt AS (SELECT CAST(e2 AS BIGINT) AS "group", total + e2 AS total FROM nulls, eff), s AS (SELECT "group", 'one_sided_positive' AS side, total > b AS hit FROM alt, crit UNION ALL SELECT "group", 'one_sided_negative', total < a FROM alt, crit UNION ALL SELECT "group", 'two_sided', total < c OR total > e FROM alt, crit)
SELECT "group", side, ROUND(AVG(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS power, COUNT(*) FILTER (hit) AS detected, COUNT(*) AS n FROM s GROUP BY 1, 2""")
def x9b(spark, d):
    nulls = validation.placebo_windows(fitted_naive(spark, d), 4).select(F.col("uplift").alias("total"))
    alt = nulls.select(F.explode(F.array(*map(F.lit, (0.0, 50000.0, 200000.0)))).alias("e"), "total").select(F.col("e").cast("long").alias("group"), (F.col("total") + F.col("e")).alias("total"))
    return rounded(power.detection_power(nulls, alt), 6)


@query("x10_clopper_pearson")
def x10(spark, d):
    return power.with_interval(x9b(spark, d))


@query("x13_heteroskedasticity", f"""{FITTED}, k AS (SELECT actual - predicted AS residual, row_number() OVER (ORDER BY predicted, date) AS k, COUNT(*) OVER () AS n FROM fitted) SELECT ROUND(var_samp(residual) FILTER (k <= n // 2), 0) AS var_low, ROUND(var_samp(residual) FILTER (k > n - n // 2), 0) AS var_high, MAX(n) AS n, ROUND(var_samp(residual) FILTER (k > n - n // 2) / var_samp(residual) FILTER (k <= n // 2), 4) AS ratio,
var_samp(residual) FILTER (k > n - n // 2) / var_samp(residual) FILTER (k <= n // 2) >= 2.3 OR var_samp(residual) FILTER (k > n - n // 2) / var_samp(residual) FILTER (k <= n // 2) <= 1 / 2.3 AS blocked FROM k""")
def x13(spark, d):
    h = power.heteroskedasticity(fitted_naive(spark, d).select("date", F.col("predicted").alias("level"), (F.col("actual") - F.col("predicted")).alias("residual")))
    return h.select(r("var_low", 0).alias("var_low"), r("var_high", 0).alias("var_high"), "n", r("ratio").alias("ratio"), "blocked")


@query("w15_ar1_parameters", f"""{PAIRS}, e AS (SELECT region, date, actual - predicted AS e, LAG(actual - predicted) OVER (PARTITION BY region ORDER BY date) AS b FROM pairs), p AS (SELECT region, GREATEST(LEAST(corr(b, e), 0.99), -0.99) AS rho, COUNT(*) AS n FROM e GROUP BY 1)
SELECT region, ROUND(MAX(rho), 4) AS rho, MAX(n) AS n, ROUND(stddev_samp(e - rho * b), 2) AS sigma, ROUND(MAX(rho + 2 * SQRT(GREATEST(1 - rho * rho, 0) / n)), 4) AS rho_upper, CASE WHEN MAX(rho + 2 * SQRT(GREATEST(1 - rho * rho, 0) / n)) >= 0.92 THEN 'blocked' WHEN MAX(rho) >= 0.8 THEN 'supported_with_warning' ELSE 'supported' END AS status FROM e JOIN p USING (region) GROUP BY 1""")
def w15(spark, d):
    res = naive_pairs(spark, d).select("region", "date", (F.col("actual") - F.col("predicted")).alias("residual"))
    p = power.ar1_parameters(res, ["region"])
    return p.select("region", r("rho").alias("rho"), "n", r("sigma", 2).alias("sigma"), r("rho_upper").alias("rho_upper"), power.persistence_status(F.col("rho"), F.col("rho_upper")).alias("status"))


METHODS = ["model_simulation:ols", "model_simulation:lasso", "residual_simulation:ols"]


def totals(spark: SparkSession, d: str) -> DataFrame:
    """Simulated totals of eight weeks after the history."""
    m, terms = matrix(spark, d)
    end = "2000-03-31"
    return power.simulate_totals(m.where(F.col("date") <= end), terms, "2000-01-31", METHODS)


@query("x5_simulated_totals")
def x5(spark, d):
    return totals(spark, d).groupBy("method", "stream").agg(F.avg("total").alias("mean_total"), F.stddev_pop("total").alias("sd_total"), F.count("*").alias("n"))


@query("x14_power_curve")
def x14(spark, d):
    return power.power_by_effect(totals(spark, d), [0.0, 1.0, 2.0, 5.0, 10.0, 20.0, 40.0])


@query("x11_minimum_detectable")
def x11(spark, d):
    return power.minimum_detectable(power.power_by_effect(totals(spark, d), [x * 1.0 for x in range(61)]))


@query("x19_evidence_runs")
def x19(spark, d):
    return evidence.run_evidence(spark, ["plain", "persistent", "duplicate_control", "constant_control"], 3, n_sim=200)


@query("a20_evidence_summary")
def a20(spark, d):
    return evidence.summarise(x19(spark, d))


@query("a21_seed_sensitivity")
def a21(spark, d):
    return evidence.seed_sensitivity(x19(spark, d))


@query("s7_synthetic_cases")
def s7(spark, d):
    return synthetic.cases(spark, 4, pre=60, test=6, effect=0.05)


# Bayesian

@query("b2_prior_sigmas", f"{GROUPS}, s AS (SELECT group_id AS region, distance, 1 / (1 + distance) AS similarity FROM sc), e AS (SELECT MIN(similarity) AS lo, MAX(similarity) AS hi FROM s) SELECT region, ROUND(distance, 4) AS distance, ROUND(similarity, 4) AS similarity, ROUND(0.1 + 0.9 * (similarity - lo) / (hi - lo), 4) AS sigma FROM s, e")
def b2(spark, d):
    long, test = long_features(spark, d), test_regions(spark, d)
    pool = long.select("region").distinct().join(test, "region", "left_anti")
    s = matching.score_groups(pool.select(F.col("region").alias("group_id"), "region"), long, test)
    return rounded(bayes.prior_sigmas(s.select(F.col("group_id").alias("region"), "distance")))


@query("a24_correlation_bounds", f"""{LAGGED}, n AS (SELECT trim(r_name) AS region, row_number() OVER (ORDER BY r_regionkey) AS k FROM region), t AS (SELECT date, kpi AS test_kpi FROM w JOIN n USING (region) WHERE k = 1), c AS (SELECT region, ABS(corr(kpi, test_kpi)) AS r FROM w JOIN n USING (region) JOIN t USING (date) WHERE k > 1 GROUP BY 1)
SELECT ROUND(median(r), 4) AS median_abs_correlation, ROUND(GREATEST(0.05, median(r) / 4), 4) AS sigma_min, ROUND(LEAST(2.0, median(r) * 1.25), 4) AS sigma_max FROM c""")
def a24(spark, d):
    t, c = region_names(spark, d)
    w = weeks(spark, d)
    return rounded(bayes.correlation_bounds(w.where(F.col("region").isin(*c)), validation.test_series(w, t)))


def posterior(spark: SparkSession, d: str) -> DataFrame:
    """Draws for the first region: controls and their values of the week before, with priors by likeness of shape."""
    from quadrat.keyed_queries import priors

    t, c = region_names(spark, d)
    m = validation.model_matrix(weeks(spark, d), t, c, [1])
    prior = {r["feature"]: r["sigma"] for r in priors(spark, d).where(F.col("market") == t[0]).collect()}  # a row for each term
    return bayes.sample_posterior(m.where(F.col("date") <= "2000-03-31"), [x for x in m.columns if x in prior], "2000-01-31", prior, draws=2000, tune=1000)


@query("b9_posterior_uplift")
def b9(spark, d):
    return bayes.posterior_summary(posterior(spark, d))


@query("a23_convergence")
def a23(spark, d):
    p = posterior(spark, d)
    return bayes.r_hat(p, "sigma").unionByName(bayes.r_hat(p, "rho")).unionByName(bayes.r_hat(p, "uplift"))


# decisions

DERIVED = """WITH p AS (SELECT o_orderkey AS plan_id, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice::DOUBLE WHEN o_orderkey % 9 > 0 THEN o_totalprice::DOUBLE / 2 + o_totalprice::DOUBLE / 4 END AS total_budget, (o_custkey % 7)::DOUBLE AS cpm, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice::DOUBLE * 10 END AS impressions, (o_custkey % 5)::DOUBLE AS frequency,
CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice::DOUBLE * 20 END AS reach, NULL::DOUBLE AS reach_percentage, (o_custkey % 4 * 999983)::DOUBLE AS eligible_audience FROM orders), a AS (SELECT plan_id, total_budget, cpm, impressions, CASE WHEN frequency > 0 THEN frequency END AS frequency, reach, reach_percentage, eligible_audience FROM p),
b AS (SELECT * REPLACE (COALESCE(impressions, CASE WHEN cpm > 0 THEN total_budget / cpm * 1000 END) AS impressions) FROM a), c AS (SELECT * REPLACE (COALESCE(reach, CASE WHEN frequency > 0 THEN impressions / frequency END) AS reach) FROM b), e AS (SELECT * REPLACE (COALESCE(frequency, CASE WHEN reach > 0 THEN impressions / reach END) AS frequency) FROM c), f AS (SELECT * REPLACE (COALESCE(reach_percentage, CASE WHEN eligible_audience > 0 THEN reach / eligible_audience * 100 END) AS reach_percentage) FROM e)"""


def media_plans(spark: SparkSession, d: str) -> DataFrame:
    """A plan for each order: some with weekly amounts, of which a negative one voids the pattern, and each lacking other figures."""
    o = sp.table(spark, d, "orders")
    k, c, v = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice").cast("double")
    weekly = F.create_map(F.lit("w1"), v / 2, F.lit("w2"), F.when(k % 9 == 0, -v).otherwise(v / 4))
    some = lambda test, x: F.when(test, x)
    return o.select(
        k.alias("plan_id"), some(k % 3 > 0, v).alias("total_budget"), some(k % 3 == 0, weekly).alias("weekly"), (c % 7).cast("double").alias("cpm"), some(k % 11 == 0, v * 10).alias("impressions"),
        some(c % 5 > 0, (c % 5).cast("double")).alias("frequency"), some(k % 13 == 0, v * 20).alias("reach"), F.lit(None).cast("double").alias("reach_percentage"), (c % 4 * 999983).cast("double").alias("eligible_audience"),
    )


@query("d2_media_delivery", f"""{DERIVED} SELECT plan_id, ROUND(total_budget, 4) AS total_budget, ROUND(impressions, 4) AS impressions, ROUND(reach, 4) AS reach, ROUND(frequency, 4) AS frequency, ROUND(reach_percentage, 4) AS reach_percentage,
CASE WHEN impressions < 100000 OR reach < 50000 THEN 'not_feasible' WHEN reach_percentage > 100 OR frequency <= 0 THEN 'blocked' WHEN COALESCE(impressions, 0) = 0 OR COALESCE(reach, 0) = 0 THEN 'incomplete' ELSE 'feasible' END AS status FROM f""")
def d2(spark, d):
    x = decisions.assess_delivery(media_plans(spark, d), 100000, 50000)
    return rounded(x.select("plan_id", "total_budget", "impressions", "reach", "frequency", "reach_percentage", "status"))


@query("d3_weekly_presets", "SELECT shape, week, amount::DOUBLE AS amount FROM (VALUES ('even', 0, 33.33), ('even', 1, 33.33), ('even', 2, 33.34), ('front', 0, 50.0), ('front', 1, 33.33), ('front', 2, 16.67), ('back', 0, 16.67), ('back', 1, 33.33), ('back', 2, 50.0)) AS t(shape, week, amount)")
def d3(spark, d):
    shapes = [spark.range(1).select(F.lit(s).alias("shape"), F.posexplode(decisions.weekly_preset(100.0, 3, s)).alias("week", "amount")) for s in ("even", "front", "back")]
    return shapes[0].unionByName(shapes[1]).unionByName(shapes[2])


DIRECTIONS = ("one_sided_positive", "one_sided_negative", "two_sided")


@query("d4_effect_plausibility", f"""WITH c AS (SELECT c_custkey AS case_id, CASE WHEN c_acctbal < 0 AND c_custkey % 2 = 1 THEN 'blocked' WHEN c_mktsegment = 'BUILDING' OR c_nationkey % 4 = 0 THEN 'conditional' ELSE 'evidence_backed' END AS status, CASE WHEN c_nationkey % 6 < 5 THEN (c_nationkey % 6)::DOUBLE END AS mde, list_extract({list(DIRECTIONS)}, c_custkey % 3 + 1) AS dir, c_acctbal::DOUBLE AS v FROM customer),
s AS (SELECT case_id, status, mde, dir, label, v / per AS uplift_pct FROM c, (VALUES ('low', 2000.0::DOUBLE), ('central', 1000.0::DOUBLE), ('high', 500.0::DOUBLE)) AS l(label, per)), x AS (SELECT *, CASE dir WHEN 'one_sided_positive' THEN uplift_pct WHEN 'one_sided_negative' THEN -uplift_pct ELSE ABS(uplift_pct) END AS dist FROM s) SELECT case_id, label, ROUND(uplift_pct, 8) AS uplift_pct, status, dist >= mde AS meets_mde, ROUND(dist - mde, 8) AS margin_pct FROM x""")
def d4(spark, d):
    k, n, v = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal").cast("double")
    evidence = sp.table(spark, d, "customer").select(
        k.alias("case_id"), F.when(F.col("c_mktsegment") == "BUILDING", "analyst_assumption").otherwise("prior_test").alias("evidence_type"), F.when(n % 4 == 0, "unknown").otherwise("high").alias("quality"), (F.col("c_acctbal") < 0).alias("adjusted"), (k % 2 == 0).alias("central_approved"),
        F.when(n % 6 < 5, (n % 6).cast("double")).alias("mde_pct"), F.element_at(F.array(*map(F.lit, DIRECTIONS)), (k % 3 + 1).cast("int")).alias("direction"), F.create_map(F.lit("low"), v / 2000, F.lit("central"), v / 1000, F.lit("high"), v / 500).alias("scenarios"),
    )
    return rounded(decisions.assess_effects(evidence), 8)


_D = """WITH x AS (SELECT s_suppkey::INTEGER AS position, 's' || s_suppkey AS scenario_id, (s_suppkey % 10) / 10.0::DOUBLE AS size_metric, (4 + s_nationkey % 6)::INTEGER AS duration_periods, CASE WHEN s_acctbal > 0 THEN s_acctbal::DOUBLE END AS cost, CASE WHEN s_suppkey % 7 = 0 THEN 'fail' ELSE ' Pass ' END AS match_status, CASE WHEN s_suppkey % 5 = 0 THEN 'weak' ELSE 'credible' END AS counterfactual_status,
CASE WHEN s_nationkey = 3 THEN 'blocked' ELSE 'supported' END AS power_status, CASE WHEN s_nationkey % 8 = 1 THEN 'incomplete' ELSE 'feasible' END AS delivery_status, CASE s_suppkey % 3 WHEN 0 THEN 'evidence_backed' WHEN 1 THEN 'conditional' ELSE 'unknown' END AS effect_status, 'valid' AS region_constraints_status, s_suppkey % 11 > 0 AS power_usable, s_suppkey % 13 > 0 AS power_meets_target, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 17 > 0 END AS effect_meets_mde FROM supplier)"""


def designs(spark: SparkSession, d: str) -> DataFrame:
    """A design for each supplier, its states by remainders."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    either = lambda test, a, b: F.when(test, a).otherwise(b)
    return sp.table(spark, d, "supplier").select(
        k.cast("int").alias("position"), F.concat(F.lit("s"), k.cast("string")).alias("scenario_id"), (k % 10 / 10.0).alias("size_metric"), (4 + n % 6).cast("int").alias("duration_periods"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal").cast("double")).alias("cost"),
        either(k % 7 == 0, "fail", " Pass ").alias("match_status"), either(k % 5 == 0, "weak", "credible").alias("counterfactual_status"), either(n == 3, "blocked", "supported").alias("power_status"), either(n % 8 == 1, "incomplete", "feasible").alias("delivery_status"),
        F.when(k % 3 == 0, "evidence_backed").when(k % 3 == 1, "conditional").otherwise("unknown").alias("effect_status"), F.lit("valid").alias("region_constraints_status"), (k % 11 > 0).alias("power_usable"), (k % 13 > 0).alias("power_meets_target"), F.when(k % 4 > 0, k % 17 > 0).alias("effect_meets_mde"),
    )


_OK = " AND ".join(f"lower(trim({c})) IN ('pass', 'supported', 'credible', 'valid', 'complete')" for c in ("match_status", "counterfactual_status", "power_status", "region_constraints_status"))
_CLEAN = f"({_OK} AND power_usable AND power_meets_target AND delivery_status = 'feasible' AND effect_status IN ('evidence_backed', 'conditional') AND COALESCE(effect_meets_mde, false))"


@query("d5_design_gates", f"{_D} SELECT position::INTEGER AS position, scenario_id, {_CLEAN} AND effect_status = 'evidence_backed' AS qualifies, {_CLEAN} AND effect_status = 'conditional' AS conditional FROM x")
def d5(spark, d):
    return decisions.assess_designs(designs(spark, d)).select("position", "scenario_id", "qualifies", "conditional")


@query("d6_recommendation", f"{_D}, g AS (SELECT *, {_CLEAN} AND effect_status = 'evidence_backed' AS q, {_CLEAN} AND effect_status = 'conditional' AS c FROM x) SELECT (SELECT scenario_id FROM g WHERE q OR c ORDER BY NOT q, size_metric, duration_periods, COALESCE(cost, 1e308), position LIMIT 1) AS scenario_id, CASE WHEN bool_or(q) THEN 'recommended' WHEN bool_or(c) THEN 'conditional' ELSE 'no_qualifying_design' END AS status, COUNT(*) FILTER (q) AS n_qualifying, COUNT(*) FILTER (c) AS n_conditional FROM g")
def d6(spark, d):
    return decisions.recommend(decisions.assess_designs(designs(spark, d)))


@query("k2_geo_assignment", f"WITH {TEST_SQL} SELECT 'market' AS Market, trim(n_name) AS geo, CASE WHEN n_nationkey IN (1, 2) THEN 'Yes' ELSE '' END AS Test, CASE WHEN n_regionkey = 1 AND n_nationkey NOT IN (1, 2) THEN 'Yes' ELSE '' END AS Control FROM nation")
def k2(spark, d):
    n = sp.table(spark, d, "nation")
    t = F.col("n_nationkey").isin(1, 2)
    return n.select(F.lit("market").alias("Market"), F.trim("n_name").alias("geo"), F.when(t, "Yes").otherwise("").alias("Test"), F.when((F.col("n_regionkey") == 1) & ~t, "Yes").otherwise("").alias("Control"))


@query("a15_data_validation", f"""WITH {LONGF}, s AS (SELECT feature, AVG(value) AS mu, stddev_pop(value) AS sd, COUNT(DISTINCT value) AS n_distinct, COUNT(*) AS n FROM lf GROUP BY 1) SELECT s.feature, n, n_distinct, n_distinct <= 1 AS constant, COUNT(*) FILTER (sd > 0 AND ABS(value - mu) / sd > 2) AS outliers FROM s JOIN lf USING (feature) GROUP BY ALL""")
def a15(spark, d):
    w = Window.partitionBy("feature")
    z = F.abs(F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_pop("value").over(w), F.lit(0.0))
    x = long_features(spark, d).withColumn("z", z).groupBy("feature").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_distinct"), F.count_if(F.col("z") > 2).alias("outliers"))
    return x.select("feature", "n", "n_distinct", (F.col("n_distinct") <= 1).alias("constant"), "outliers")


@query("f3_lag_terms", "SELECT feature, CASE WHEN regexp_matches(feature, '_lag[0-9]+$') THEN regexp_replace(feature, '_lag[0-9]+$', '') ELSE feature END AS region, COALESCE(TRY_CAST(regexp_extract(feature, '_lag([0-9]+)$', 1) AS INTEGER), 0) AS lag FROM (SELECT trim(n_name) || CASE WHEN n_nationkey % 3 = 0 THEN '_lag' || n_nationkey ELSE '' END AS feature FROM nation)")
def f3(spark, d):
    n = sp.table(spark, d, "nation").select(F.concat(F.trim("n_name"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("_lag"), "n_nationkey")).otherwise("")).alias("feature"))
    return n.select("feature", fc.lag_term(F.col("feature")).alias("x")).select("feature", "x.region", "x.lag")


@query("f10_period_counts", "SELECT o_custkey, (datediff('day', MIN(o_orderdate)::DATE, MAX(o_orderdate)::DATE) // 7 + 1)::BIGINT AS periods FROM orders GROUP BY 1")
def f10(spark, d):
    o = sp.table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    return o.select("o_custkey", fc.period_count(F.col("a"), F.col("b"), 7).cast("long").alias("periods"))


@query("st_daily_panel_stream", DAYS)
def st(spark, d):
    return panel_stream.run_once(panel_stream.daily_panel(panel_stream.read_events(spark, d)))


# sets, order and shape

@query("u_set_operations", """SELECT 'union' AS op, region FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0) UNION SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey, LATERAL (SELECT trim(n_name) AS region)
UNION ALL SELECT 'intersect', trim(n_name) FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey
UNION ALL SELECT 'except', trim(n_name) FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey""")
def u_sets(spark, d):
    n = sp.table(spark, d, "nation").select("n_nationkey", F.trim("n_name").alias("region"))
    a = sp.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    b = sp.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda op, x: x.join(n, F.col("k") == F.col("n_nationkey")).select(F.lit(op).alias("op"), "region")
    return named("union", a.union(b).distinct()).unionByName(named("intersect", a.intersect(b))).unionByName(named("except", n.select(F.col("n_nationkey").alias("k")).subtract(b)))


@query("u6_key_set_equality", "SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT o_custkey FROM orders) ANTI JOIN customer ON o_custkey = c_custkey) AS only_left, (SELECT COUNT(*) FROM customer ANTI JOIN orders ON o_custkey = c_custkey) AS only_right")
def u6(spark, d):
    a, b = sp.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct(), sp.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return a.join(b, "k", "left_anti").agg(F.count("*").alias("only_left")).crossJoin(b.join(a, "k", "left_anti").agg(F.count("*").alias("only_right")))


@query("o6_strided_sample", f"{LAGGED}, dd AS (SELECT DISTINCT date FROM w), i AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS n FROM dd) SELECT date, i FROM i WHERE i % (n // 20) = 0 ORDER BY i LIMIT 20")
def o6(spark, d):
    i = weeks(spark, d).select("date").distinct().withColumn("i", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))  # a few hundred dates
    n = i.agg(F.count("*").alias("n"))
    return i.join(F.broadcast(n)).where(F.col("i") % F.floor(F.col("n") / 20) == 0).orderBy("i").limit(20).select("date", "i")


@query("o9_first_of_duplicates", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn = 1")
def o9(spark, d):
    c = sp.table(spark, d, "customer")
    return c.groupBy("c_nationkey").agg(F.min_by(F.struct("c_custkey", "c_acctbal"), F.struct((-F.col("c_acctbal")).alias("b"), "c_custkey")).alias("x")).select("c_nationkey", "x.*")


@query("o4_head_of_list", f"WITH m AS ({MONTHS}) SELECT region, array_to_string(list_slice(list(strftime(date, '%Y-%m-%d') ORDER BY date), 1, 3), ', ') AS first_dates, COUNT(*) AS n FROM m GROUP BY 1")
def o4(spark, d):
    return months(spark, d).groupBy("region").agg(F.array_join(F.slice(F.array_sort(F.collect_list(F.col("date").cast("string"))), 1, 3), ", ").alias("first_dates"), F.count("*").alias("n"))


@query("r8_chart_series", f"{LAGGED}, i AS (SELECT region, date, kpi, kpi / AVG(kpi) FILTER (date <= DATE '{PRE_END}') OVER (PARTITION BY region) * 100 AS indexed FROM w) SELECT date, region || ' ' || 'kpi' AS series, ROUND(kpi, 2) AS value FROM i UNION ALL SELECT date, region || ' indexed', ROUND(indexed, 2) FROM i")
def r8(spark, d):
    pre = F.avg(F.when(F.col("date") <= PRE_END, F.col("kpi"))).over(Window.partitionBy("region"))
    i = weeks(spark, d).select("region", "date", "kpi", (F.col("kpi") / pre * 100).alias("indexed"))
    return i.unpivot(["region", "date"], ["kpi", "indexed"], "kind", "value").select("date", F.concat_ws(" ", "region", "kind").alias("series"), r("value", 2).alias("value"))


@query("r9_comparison_matrix", f"{PAIRS}, e AS (SELECT region, AVG(ABS(actual - predicted)) AS mae, SQRT(AVG(POWER(actual - predicted, 2))) AS rmse FROM pairs GROUP BY 1), u AS (UNPIVOT e ON mae, rmse INTO NAME metric VALUE v), n AS (SELECT trim(r_name) AS region, row_number() OVER (ORDER BY r_regionkey) AS k FROM region) SELECT metric, {', '.join(f'ROUND(MAX(v) FILTER (k = {k}), 2) AS m{k}' for k in range(1, 6))} FROM u JOIN n USING (region) GROUP BY 1")
def r9(spark, d):
    e = naive_pairs(spark, d).groupBy("region").agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"), F.sqrt(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2))).alias("rmse"))
    t, c = region_names(spark, d)
    x = e.unpivot(["region"], ["mae", "rmse"], "metric", "v").groupBy("metric").pivot("region", t + c).agg(F.max("v"))
    return x.select("metric", *(r(F.col(f"`{n}`"), 2).alias(f"m{k + 1}") for k, n in enumerate(t + c)))


@query("p16_exclude_dates", f"{LAGGED}, q AS (SELECT date FROM w GROUP BY 1 HAVING SUM(kpi) < 100000) SELECT region, date, kpi FROM w ANTI JOIN q USING (date) WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def p16(spark, d):
    w = weeks(spark, d).where(F.col("date").between("1996-01-01", "1998-12-31"))
    return w.join(w.groupBy("date").agg(F.sum("kpi").alias("s")).where("s < 100000").select("date"), "date", "left_anti").select("region", "date", "kpi")


@query("p21_region_roles", "SELECT trim(n_name) AS region, CASE WHEN n_nationkey IN (1, 2) THEN 'test' WHEN n_nationkey % 5 = 4 THEN 'excluded' WHEN n_regionkey = 1 THEN 'matched control' ELSE 'candidate' END AS role FROM nation")
def p21(spark, d):
    k = F.col("n_nationkey")
    role = F.when(k.isin(1, 2), "test").when(k % 5 == 4, "excluded").when(F.col("n_regionkey") == 1, "matched control").otherwise("candidate")
    return sp.table(spark, d, "nation").select(F.trim("n_name").alias("region"), role.alias("role"))


@query("p25_pre_test_split", f"{LAGGED}, dd AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM w)) SELECT w.region, w.date, CASE WHEN k <= 104 THEN 'pre' ELSE 'test' END AS part FROM w JOIN dd USING (date) WHERE k <= 112")
def p25(spark, d):
    w = weeks(spark, d)
    dates = w.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date"))).where("k <= 112")
    return w.join(F.broadcast(dates), "date").select("region", "date", F.when(F.col("k") <= 104, "pre").otherwise("test").alias("part"))  # 112 rows


@query("p19_typed_columns", "SELECT p_type, COUNT(*) AS n, bool_and(regexp_full_match(CAST(p_size AS VARCHAR), '[0-9.,-]+')) AS size_is_numeric, bool_and(regexp_full_match(p_brand, '[0-9.,-]+')) AS brand_is_numeric FROM part GROUP BY 1")
def p19(spark, d):
    looks = lambda c: F.bool_and(fc.looks_numeric(F.col(c).cast("string")))
    return sp.table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), looks("p_size").alias("size_is_numeric"), looks("p_brand").alias("brand_is_numeric"))


@query("a9_distinct_lists", f"WITH m AS ({MONTHS}) SELECT COUNT(DISTINCT region) AS regions, COUNT(DISTINCT date) AS dates, array_to_string(list(DISTINCT region ORDER BY region), ', ') AS region_list FROM m")
def a9(spark, d):
    return months(spark, d).agg(F.countDistinct("region").alias("regions"), F.countDistinct("date").alias("dates"), F.array_join(F.array_sort(F.collect_set("region")), ", ").alias("region_list"))


@query("a14_population_coverage", f"WITH demo AS ({DEMOGRAPHICS}) SELECT n_regionkey, ROUND(SUM(Population) FILTER (suppliers IS NOT NULL) / SUM(Population) * 100, 4) AS coverage_pct FROM demo GROUP BY 1")
def a14(spark, d):
    x = sp.demographics(spark, d).groupBy("n_regionkey").agg((F.sum(F.when(F.col("suppliers").isNotNull(), F.col("Population"))) / F.sum("Population") * 100).alias("coverage_pct"))
    return rounded(x)


@query("w13_ar1_recursion", f"{PAIRS}, e AS (SELECT region, (actual - predicted) / 1e6 AS v, row_number() OVER (PARTITION BY region ORDER BY date) AS k, COUNT(*) OVER (PARTITION BY region) AS n FROM pairs) SELECT region, ROUND(SUM(v * POWER(0.5, n - k)), 4) AS last_level FROM e GROUP BY 1")
def w13(spark, d):
    """e_t = 0.5 e_(t-1) + v_t, as a fold over the innovations of each region."""
    v = naive_pairs(spark, d).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("date", ((F.col("actual") - F.col("predicted")) / 1e6).alias("v")))).alias("vs"))
    return v.select("region", r(F.aggregate("vs", F.lit(0.0), lambda e, x: 0.5 * e + x["v"])).alias("last_level"))


@query("j8_window_range_join", f"{LAGGED}, s AS (SELECT UNNEST([DATE '1996-01-01', DATE '1997-01-06', DATE '1998-01-05']) AS start) SELECT start, region, COUNT(*) AS n, ROUND(SUM(kpi), 2) AS total FROM s JOIN w ON w.date >= s.start AND w.date < s.start + 56 GROUP BY 1, 2")
def j8(spark, d):
    """Windows of eight weeks: their dates are exploded, so that the join is by equality."""
    s = spark.createDataFrame([(x,) for x in ("1996-01-01", "1997-01-06", "1998-01-05")], "s string").select(F.to_date("s").alias("start"))
    days = s.select("start", F.explode(F.expr("sequence(start, date_add(start, 49), interval 7 day)")).alias("date"))
    return weeks(spark, d).join(F.broadcast(days), "date").groupBy("start", "region").agg(F.count("*").alias("n"), r(F.sum("kpi"), 2).alias("total"))  # 24 rows


@query("j12_near_equal_series", f"WITH m AS ({MONTHS}), i AS (SELECT region, date, kpi / AVG(kpi) OVER (PARTITION BY region) AS v FROM m) SELECT a.region AS a, b.region AS b, COUNT(*) AS n, ROUND(AVG(ABS(a.v - b.v)), 6) AS mean_gap FROM i AS a JOIN i AS b ON a.date = b.date AND a.region < b.region GROUP BY 1, 2 HAVING bool_and(ABS(a.v - b.v) <= 1.5) AND COUNT(*) >= 70")
def j12(spark, d):
    i = months(spark, d).select("region", "date", (F.col("kpi") / F.avg("kpi").over(Window.partitionBy("region"))).alias("v"))
    j = i.select(F.col("region").alias("other"), "date", F.col("v").alias("u"))
    g = F.abs(F.col("v") - F.col("u"))
    x = i.join(j, "date").where("region < other").groupBy(F.col("region").alias("a"), F.col("other").alias("b")).agg(F.count("*").alias("n"), F.avg(g).alias("mean_gap"), F.bool_and(g <= 1.5).alias("near"))
    return x.where("near and n >= 70").select("a", "b", "n", r("mean_gap", 6).alias("mean_gap"))


@query("j17_source_availability", "SELECT 's' || n_nationkey AS source, CASE WHEN n_nationkey % 4 = 0 THEN 'missing' WHEN n_nationkey % 4 = 1 THEN 'new' WHEN n_nationkey % 4 = 2 THEN 'matched' ELSE 'changed' END AS state FROM nation")
def j17(spark, d):
    n = sp.table(spark, d, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("source"), (F.col("n_nationkey") % 4).alias("m"))
    return records.source_availability(n.where("m != 1").select("source", F.lit("x").alias("digest")), n.where("m != 0").select("source", F.when(F.col("m") == 3, "y").otherwise("x").alias("digest")))


@query("j9_candidate_grid", "SELECT share::DOUBLE AS share, duration FROM (SELECT UNNEST([0.1, 0.2, 0.4]) AS share), (SELECT UNNEST([4, 8])::INTEGER AS duration)")
def j9(spark, d):
    return sizing.candidate_grid(spark, [0.1, 0.2, 0.4], [4, 8])


@query("x15_sized_scenarios")
def x15(spark, d):
    return sizing.size_scenarios(months(spark, d), sizing.candidate_grid(spark, [0.1, 0.2, 0.4], [4, 8]), 0.15, min_history=60)


@query("x16_smallest_qualifying")
def x16(spark, d):
    return sizing.smallest_qualifying(x15(spark, d))


@query("d14_content_digests")
def d14(spark, d):
    return records.content_digest(months(spark, d)).withColumn("what", F.lit("panel")).unionByName(records.content_digest(sp.demographics(spark, d)).withColumn("what", F.lit("demographics")))


@query("a26_reason_union", "SELECT l_returnflag, array_to_string(list(DISTINCT l_linestatus ORDER BY l_linestatus), ',') AS statuses, COUNT(*) AS n FROM lineitem GROUP BY 1")
def a26(spark, d):
    x = sp.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("statuses"), F.count("*").alias("n"))
    return x


@query("f14_grids", "SELECT k::INTEGER AS k, ROUND(POWER(10, 4 - 8.0 * k / 49), 6) AS alpha, ROUND(0.0 + 30.0 * k / 49, 6) AS effect FROM (SELECT UNNEST(range(50)) AS k)")
def f14(spark, d):
    k = F.col("id")
    return spark.range(50).select(k.cast("int").alias("k"), r(F.pow(F.lit(10.0), 4 - 8.0 * k / 49), 6).alias("alpha"), r(30.0 * k / 49, 6).alias("effect"))


# catalogue, plans, exports

@query("s13_platform_profiles", "SELECT * FROM (VALUES " + ", ".join(f"('meta_auction_social', '{k}', '{t}', {'NULL' if u is None else repr(u)}, false)" for k, t, u in catalogue.FIELDS) + ") AS t(profile_id, field, value_type, unit, required)")
def s13(spark, d):
    return catalogue.profile_fields(spark)


PLAN_VALUES = [("p1", "reach", "numeric", 5.0, None), ("p1", "cpm", "text", None, "five"), ("p1", "budgett", "numeric", 1.0, None), ("p2", "frequency", "numeric", -1.0, None), ("p2", "forecast_date", "text", None, "2024-13-01"), ("p2", "forecast_source", "text", None, "desk"), ("p3", "forecast_date", "text", None, "2024-12-01T00:00:00")]


@query("d1_plan_errors", "SELECT * FROM (VALUES ('p1', 'cpm must be numeric'), ('p1', 'unknown field budgett'), ('p2', 'frequency must be non-negative'), ('p2', 'forecast_date must be a valid ISO date')) AS t(plan_id, error)")
def d1(spark, d):
    v = spark.createDataFrame([(p, "meta_auction_social", f, k, n, t) for p, f, k, n, t in PLAN_VALUES], "plan_id string, profile_id string, field string, kind string, number double, text string")
    return decisions.plan_errors(v, catalogue.profile_fields(spark))


@query("d17_constraint_status", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 OR n_nationkey % 2 = 1 THEN 'blocked' ELSE 'pass' END AS status FROM nation")
def d17(spark, d):
    """Nations as candidates: those of region 0 are excluded from both groups, odd ones forced into a group that they aren't in."""
    name = F.trim("n_name")
    none = F.array().cast("array<string>")
    x = sp.table(spark, d, "nation").select("n_nationkey", F.array(name).alias("tests"), F.array(F.lit("other")).alias("controls"), none.alias("force_test"), F.when(F.col("n_nationkey") % 2 == 1, F.array(name)).otherwise(none).alias("force_control"), F.when(F.col("n_regionkey") == 0, F.array(name)).otherwise(none).alias("exclude_both"), none.alias("test_exclude"), none.alias("control_exclude"))
    return decisions.constraint_status(x).select("n_nationkey", "status")


@query("d7_candidate_state", "SELECT n_nationkey, n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 AND n_nationkey >= 8 AS usable FROM nation")
def d7(spark, d):
    k = F.col("n_nationkey")
    x = sp.table(spark, d, "nation").select("n_nationkey", (k % 2 == 0).alias("passes_quality"), F.lit(True).alias("power_completed"), (k % 3 != 0).alias("power_usable"), (k / 10).alias("power"))
    return decisions.candidate_state(x, 0.8).select("n_nationkey", "usable")


@query("k7_chart_series", f"{FITTED}, b AS (SELECT AVG(actual) FILTER (date <= DATE '{PRE_END}') AS a, AVG(predicted) FILTER (date <= DATE '{PRE_END}') AS p FROM fitted) SELECT date, 'Actual' AS series, ROUND(actual, 2) AS value FROM fitted UNION ALL SELECT date, 'Predicted', ROUND(predicted, 2) FROM fitted UNION ALL SELECT date, 'Actual indexed', ROUND(actual / a * 100, 2) FROM fitted, b UNION ALL SELECT date, 'Predicted indexed', ROUND(predicted / p * 100, 2) FROM fitted, b")
def k7(spark, d):
    return rounded(sinks.chart_series(fitted_naive(spark, d), PRE_END), 2)


@query("k6_result_documents", "SELECT COUNT(*) AS n, COUNT(DISTINCT region) AS regions FROM (SELECT trim(n_name) AS region FROM nation)")
def k6(spark, d):
    docs = sinks.as_json(sp.table(spark, d, "nation").select(F.trim("n_name").alias("region"), F.lit(None).cast("double").alias("mde")))
    back = docs.select(F.from_json("json", "region string, mde double").alias("x"))
    return back.agg(F.count("*").alias("n"), F.countDistinct("x.region").alias("regions"))


@query("p7_repaired_text", "SELECT n_nationkey, trim(n_name) || '–é' AS fixed FROM nation")
def p7(spark, d):
    wrong = F.concat(F.lit(" "), F.trim("n_name"), F.lit("--"), F.when(F.col("n_nationkey") % 2 == 0, "Ã©").otherwise("e\u0301"), F.lit(" "))
    return sp.table(spark, d, "nation").select("n_nationkey", fc.repaired_text(wrong).alias("fixed"))


@query("p5_error_tokens", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey::DOUBLE END AS value FROM nation")
def p5(spark, d):
    cell = F.when(F.col("n_nationkey") % 3 == 0, "#DIV/0!").otherwise(F.col("n_nationkey").cast("string"))
    return sp.table(spark, d, "nation").select("n_nationkey", fc.number(fc.drop_error_tokens(cell)).alias("value"))


@query("p24_feature_labels", "SELECT DISTINCT 'wk_' || strftime(o_orderdate, '%Y%m%d') AS feature, strftime(o_orderdate, '%d %b %y') AS label FROM orders")
def p24(spark, d):
    f = sp.table(spark, d, "orders").select(F.concat(F.lit("wk_"), F.date_format("o_orderdate", "yyyyMMdd")).alias("feature")).distinct()
    return f.select("feature", fc.kpi_feature_label(F.col("feature")).alias("label"))


@query("j14_interpolated_power", f"""{FITTED}, thr AS (SELECT quantile_cont(uplift_pct, 0.95) AS hi FROM pw), c AS (SELECT e, AVG(CASE WHEN uplift_pct * (1 + e / 100) + e > hi THEN 1.0 ELSE 0.0 END) AS p FROM pw, thr, (SELECT UNNEST(range(1, 61)) * 0.5::DOUBLE AS e) GROUP BY 1), q AS (SELECT UNNEST([0.2, 3.25, 11.1, 40.0]) AS x),
lo AS (SELECT x, MAX(e) AS e0 FROM q JOIN c ON e <= x GROUP BY 1), hi AS (SELECT x, MIN(e) AS e1 FROM q JOIN c ON e > x GROUP BY 1) SELECT x::DOUBLE AS effect_pct, ROUND(CASE WHEN e0 IS NULL THEN b.p WHEN e1 IS NULL THEN a.p ELSE a.p + (x - e0) * (b.p - a.p) / (e1 - e0) END, 6) AS power FROM q LEFT JOIN lo USING (x) LEFT JOIN hi USING (x) LEFT JOIN c AS a ON a.e = e0 LEFT JOIN c AS b ON b.e = e1""")
def j14(spark, d):
    curve = validation.power_curve(validation.placebo_windows(fitted_naive(spark, d), 4))
    pts = curve.agg(F.array_sort(F.collect_list(F.struct(F.col("effect_pct").alias("x"), F.col("power_lift").alias("y")))).alias("pts"))
    return pts.select("pts", F.explode(F.array(*map(F.lit, (0.2, 3.25, 11.1, 40.0)))).alias("effect_pct")).select("effect_pct", r(fc.interpolated(F.col("pts"), F.col("effect_pct")), 6).alias("power"))


# the flagship: which nations best control for a test nation, by the shape of their monthly KPI

FLAGSHIP = f"""WITH m AS ({MONTHS}), i AS (SELECT region, date, kpi / AVG(kpi) OVER (PARTITION BY region) * 100 AS v FROM m), t AS (SELECT date, v FROM i WHERE region = (SELECT trim(n_name) FROM nation WHERE n_nationkey = 1)),
s AS (SELECT i.region, COUNT(*) AS n_dates, SQRT(AVG(POWER(i.v - t.v, 2))) AS distance, corr(i.v, t.v) AS c FROM i JOIN t USING (date) WHERE i.region <> (SELECT trim(n_name) FROM nation WHERE n_nationkey = 1) GROUP BY 1) SELECT region, n_dates, ROUND(distance, 4) AS distance, ROUND(c, 4) AS correlation FROM s ORDER BY s.distance, region LIMIT 10"""


@query("flagship_best_controls", FLAGSHIP)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = matching.index_to_100(months(spark, sf_dir)).select("region", "date", F.col("indexed").alias("v"))
    name = F.broadcast(sp.table(spark, sf_dir, "nation").where("n_nationkey = 1").select(F.trim("n_name").alias("name")))  # one row
    t = i.join(name, F.col("region") == F.col("name"), "left_semi").select("date", F.col("v").alias("t"))
    own = i.join(name, F.col("region") == F.col("name"), "left_anti").join(t, "date")
    s = own.groupBy("region").agg(F.count("*").alias("n_dates"), F.sqrt(F.avg(F.pow(F.col("v") - F.col("t"), 2))).alias("distance"), F.corr("v", "t").alias("correlation"))
    return rounded(s.orderBy("distance", "region").limit(10))


def _all() -> None:
    from quadrat import keyed_queries, shaping_queries, summary_queries  # noqa: F401  register their own, with helpers of this module


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
