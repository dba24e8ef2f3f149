"""Queries of whole runs, keyed by market: validation, power, safety, posterior summaries and records; registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrat.operators import contract, keyed, lineage, matching, posterior
from quadrat.queries import DAYS, LAGGED, LONGF, MONTHS, PRE_END, STATS, TEST_SQL, WEEKS, long_features, months, naive_pairs, query, r, rounded, test_regions, weeks
from quadrat.sources import panel as sp
from quadrat.sources.sinks import written

LAGS = [1]

# the runs: every region is a market; its matched controls are the two whose history is most like its own; regions of the next
# key are excluded for markets of an even key

REGION_KEYS = "n AS (SELECT trim(r_name) AS region, r_regionkey AS k FROM region)"
RUNS = f"""{LAGGED}, {REGION_KEYS}, others AS (SELECT a.region AS market, b.region, a.k AS mk, b.k AS rk FROM n AS a JOIN n AS b ON a.region <> b.region),
likeness AS (SELECT m.region AS market, c.region, corr(m.kpi, c.kpi) AS c FROM w AS m JOIN w AS c ON c.date = m.date AND c.region <> m.region WHERE m.date <= DATE '{PRE_END}' GROUP BY 1, 2),
best AS (SELECT market, region FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY c DESC, region) AS p FROM likeness) WHERE p <= 2),
chosen AS (SELECT market, 'matched' AS method, region FROM best UNION ALL SELECT market, 'all', region FROM others UNION ALL SELECT market, 'without_excluded', region FROM others WHERE mk % 2 = 0 AND rk <> (mk + 1) % 5),
runs AS (SELECT market, method, region, row_number() OVER (PARTITION BY market, method ORDER BY region) AS k FROM chosen)"""


def runs(spark, d):
    w = weeks(spark, d)
    names = sp.table(spark, d, "region").select(F.trim("r_name").alias("market"), F.col("r_regionkey").alias("mk"))
    own, other = w.select(F.col("region").alias("market"), "date", F.col("kpi").alias("m")), w.select("region", "date", "kpi")
    like = own.where(F.col("date") <= F.lit(PRE_END).cast("date")).join(other, "date").where("market != region").groupBy("market", "region").agg(F.corr("m", "kpi").alias("c"))
    matched = like.groupBy("market").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "region"))), 1, 2).alias("x")).select("market", F.explode("x.region").alias("region"))
    excluded = names.where("mk % 2 = 0").withColumn("rk", (F.col("mk") + 1) % 5).join(names.select(F.col("market").alias("region"), F.col("mk").alias("rk")), "rk").select("market", "region")
    return keyed.three_methods(w, names.select("market"), matched, excluded)


@query("v9_runs", f"{RUNS} SELECT market, method, region, k::INTEGER AS k FROM runs")
def v9_runs(spark, d):
    return runs(spark, d)


DESIGN = f"""{RUNS}, terms AS (SELECT market, method, region, l.lag, row_number() OVER (PARTITION BY market, method ORDER BY l.lag, k) AS e FROM runs CROSS JOIN (VALUES (0), (1)) AS l(lag)),
cells AS (SELECT t.market, t.method, t.e, w.date + t.lag * 7 AS date, w.kpi AS v, t.region, t.lag FROM terms AS t JOIN w ON w.region = t.region WHERE t.lag = 0 OR EXISTS (SELECT 1 FROM w AS x WHERE x.region = t.region AND x.date = w.date + 7)),
full_dates AS (SELECT c.market, c.method, c.date FROM cells AS c JOIN w ON w.region = c.market AND w.date = c.date GROUP BY 1, 2, 3 HAVING COUNT(*) = (SELECT COUNT(*) FROM terms AS t WHERE t.market = c.market AND t.method = c.method)),
long AS (SELECT market, method, date, e, v, region, lag FROM cells SEMI JOIN full_dates USING (market, method, date)), y AS (SELECT f.market, f.method, f.date, w.kpi AS y FROM full_dates AS f JOIN w ON w.region = f.market AND w.date = f.date)"""


def designs(spark, d, lags=LAGS):
    return keyed.design(weeks(spark, d), runs(spark, d), lags)


@query("v9_moment_sums", f"""{DESIGN}, a AS (SELECT market, method, date, e, v FROM long UNION ALL SELECT market, method, date, 0, 1.0 FROM full_dates UNION ALL SELECT market, method, date, (SELECT COUNT(*) + 1 FROM terms AS t WHERE t.market = y.market AND t.method = y.method), y FROM y)
SELECT p.market, p.method, p.e::INTEGER AS p, q.e::INTEGER AS q, COUNT(*) AS n, ROUND(AVG(p.v / 1e4 * (q.v / 1e4)), 3) AS mean_product FROM a AS p JOIN a AS q USING (market, method, date) WHERE p.date <= DATE '{PRE_END}' GROUP BY ALL""")
def v9_moments(spark, d):
    """The moments of every run's history, the last of the prefixes that its fits share."""
    own = designs(spark, d).withColumn("x", F.transform("x", lambda v: v / 1e4)).withColumn("y", F.col("y") / 1e4)
    ends = own.where(F.col("date") <= F.lit(PRE_END).cast("date")).groupBy(*keyed.RUN).agg(F.count("*").cast("int").alias("at"))
    sums = keyed.prefix_moments(own, ends)
    width = F.sqrt(F.size("moments")).cast("int")
    rows = sums.select(*keyed.RUN, F.col("at").cast("long").alias("n"), width.alias("width"), F.posexplode("moments").alias("k", "v"))
    p, q = (F.col("k") / F.col("width")).cast("int"), F.col("k") % F.col("width")
    unit = lambda c: F.when(c == 0, 1e4).otherwise(1.0)  # noqa: E731  the constant is no amount
    return rows.select(*keyed.RUN, p.alias("p"), q.alias("q"), "n", r(F.col("v") / F.col("n") / unit(p) / unit(q), 3).alias("mean_product"))


@query("v9_design_loss", f"""{DESIGN}, size AS (SELECT market, method, COUNT(*) AS n_dates FROM full_dates GROUP BY 1, 2), dates AS (SELECT DISTINCT r.market, r.method, w.date FROM runs AS r JOIN w ON w.region = r.region OR w.region = r.market), b AS (SELECT market, method, COUNT(*) AS n_before FROM dates GROUP BY 1, 2)
SELECT market, method, n_before, n_dates, CASE WHEN (n_before - n_dates) / n_before * 100 > 20 THEN 'error' WHEN (n_before - n_dates) / n_before * 100 > 10 THEN 'warning' ELSE 'none' END AS row_loss FROM size JOIN b USING (market, method)""")
def v7_design_loss(spark, d):
    x = designs(spark, d).groupBy(*keyed.RUN).agg(F.max("n_before").alias("n_before"), F.count("*").alias("n_dates"))
    return x.withColumn("row_loss", keyed.row_loss(F.col("n_before"), F.col("n_dates")))


@query("v5_coefficients", f"""{DESIGN}, s AS (SELECT l.market, l.method, l.e, ANY_VALUE(l.region) AS region, ANY_VALUE(l.lag) AS lag, CASE WHEN stddev_pop(v) > 0 THEN regr_slope(y, v) ELSE 0.0 END AS coefficient, stddev_pop(v) AS dev FROM long AS l JOIN y USING (market, method, date) GROUP BY 1, 2, 3),
z AS (SELECT *, ABS(coefficient) * dev AS size, SUM(ABS(coefficient) * dev) OVER (PARTITION BY market, method) AS total, CASE WHEN lag = 0 THEN region ELSE region || '_lag' || lag END AS feature FROM s)
SELECT market, method, feature, region, CASE WHEN lag = 0 THEN 'Same week' ELSE 'Lag 1 week' END AS term, ROUND(coefficient, 4) AS coefficient, ABS(coefficient) > 1e-6 AS selected, ROUND(CASE WHEN total > 0 THEN size / total ELSE 0.0 END, 6) AS contribution, row_number() OVER (PARTITION BY market, method ORDER BY size DESC, feature)::INTEGER AS place FROM z""")
def v5(spark, d):
    """Each term's own slope as its stated coefficient, 0 for a term without spread."""
    x = designs(spark, d).select(*keyed.RUN, "y", F.posexplode("x").alias("j", "v"))
    slopes = x.groupBy(*keyed.RUN, "j").agg(F.coalesce(F.when(F.stddev_pop("v") > 0, F.regr_slope("y", "v")), F.lit(0.0)).alias("b"), F.stddev_pop("v").alias("s"))
    packed = slopes.groupBy(*keyed.RUN).agg(F.array_sort(F.collect_list(F.struct("j", "b", "s"))).alias("q")).select(*keyed.RUN, F.transform("q", lambda q: q["b"]).alias("coef"), F.transform("q", lambda q: q["s"]).alias("devs"))
    out = keyed.coefficient_table(packed, keyed.term_labels(runs(spark, d), LAGS), packed)
    return out.withColumn("coefficient", r("coefficient")).withColumn("contribution", r("contribution", 6))


@query("v9_three_methods")
def v9(spark, d):
    """All markets and methods with lagged terms, folds, placebo windows and confidence, in one plan; the tests hold it against single fits."""
    controls = written(runs(spark, d))
    own = written(keyed.design(written(weeks(spark, d)), controls, LAGS))
    return rounded(keyed.validation_run(own, PRE_END, keyed.term_labels(controls, LAGS), (13, 4), (26, 8), cut=written))


# power: draws are the sums of four weeks' errors of a prediction by the week before; odd windows against even ones

DRAWS = f"""{LAGGED}, pairs AS (SELECT w.region AS market, w.date, w.kpi AS actual, s.kpi AS predicted FROM w JOIN w AS s ON s.region = w.region AND s.date = w.date - 7),
i AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY date) - 1 AS i FROM pairs), pw AS (SELECT market, i // 4 AS bucket, SUM(actual - predicted) AS uplift, SUM(predicted) AS base FROM i GROUP BY 1, 2 HAVING COUNT(*) = 4),
draws AS (SELECT market, list(uplift ORDER BY bucket) FILTER (bucket % 2 = 1) AS alternatives, AVG(base) AS base, quantile_cont(uplift, 0.05) FILTER (bucket % 2 = 0) AS lower, quantile_cont(uplift, 0.95) FILTER (bucket % 2 = 0) AS upper FROM pw GROUP BY 1)"""


def draws(spark, d):
    w = naive_pairs(spark, d).withColumnRenamed("region", "market")
    i = w.withColumn("i", F.row_number().over(Window.partitionBy("market").orderBy("date")) - 1).withColumn("bucket", F.floor(F.col("i") / 4))
    pw = i.groupBy("market", "bucket").agg(F.sum(F.col("actual") - F.col("predicted")).alias("uplift"), F.sum("predicted").alias("base"), F.count("*").alias("n")).where("n = 4")
    even = F.when(F.col("bucket") % 2 == 0, F.col("uplift"))
    own = pw.groupBy("market").agg(F.array_sort(F.collect_list(F.when(F.col("bucket") % 2 == 1, F.struct("bucket", "uplift")))).alias("a"), F.avg("base").alias("base"), F.percentile(even, F.lit(0.05)).alias("lower"), F.percentile(even, F.lit(0.95)).alias("upper"))
    return own.select("market", F.transform("a", lambda x: x["uplift"]).alias("alternatives"), "base", "lower", "upper")


SIDES_OF = {"one_sided_positive": ("NULL", "upper", 1), "one_sided_negative": ("lower", "NULL", -1)}
SEARCHES = [("one_sided_positive", 60.0, 0.8), ("one_sided_negative", 60.0, 0.8), ("one_sided_positive", 60.0, 0.5), ("one_sided_positive", 1.5, 0.8)]


def _search_sql() -> str:
    one = "SELECT market, '{s}' AS side, {hi} AS hi, {t} AS target, alternatives, base, {lo}::DOUBLE AS lower, {up}::DOUBLE AS upper, {sign} AS sign FROM draws"
    searches = " UNION ALL ".join(one.format(s=s, hi=hi, t=t, lo=SIDES_OF[s][0], up=SIDES_OF[s][1], sign=SIDES_OF[s][2]) for s, hi, t in SEARCHES)
    share = lambda e: f"len(list_filter(alternatives, lambda x: COALESCE(x + sign * base * ({e}) / 100 < lower, false) OR COALESCE(x + sign * base * ({e}) / 100 > upper, false))) / len(alternatives)"
    return f"""WITH RECURSIVE {DRAWS.removeprefix('WITH ')}, s AS ({searches}), g AS (SELECT s.*, k, k * hi / 40 AS e, {share('k * hi / 40')} AS p FROM s, range(41) AS r(k)),
f AS (SELECT market, side, hi, target, MIN(k) FILTER (p >= target) AS k FROM g GROUP BY ALL), falls AS (SELECT market, side, hi, target, bool_or(p < before) AS down FROM (SELECT *, LAG(p) OVER (PARTITION BY market, side, hi, target ORDER BY k) AS before FROM g) GROUP BY ALL),
b AS (SELECT s.*, GREATEST(k - 1, 0) * hi / 40 AS a, k * hi / 40 AS b, 0 AS step FROM s JOIN f USING (market, side, hi, target) WHERE k IS NOT NULL
UNION ALL SELECT market, side, hi, target, alternatives, base, lower, upper, sign, CASE WHEN {share('(a + b) / 2')} >= target THEN a ELSE (a + b) / 2 END, CASE WHEN {share('(a + b) / 2')} >= target THEN (a + b) / 2 ELSE b END, step + 1 FROM b WHERE b - a > 0.01),
z AS (SELECT market, side, hi, target, MIN(b) AS mde, arg_max({share('b')}, step) AS power FROM b GROUP BY ALL)
SELECT market, side, hi::DOUBLE AS upper_bound, target::DOUBLE AS target, f.k IS NOT NULL AS reached, NOT down AS monotone, ROUND(mde, 6) AS mde_pct, ROUND(power, 6) AS power FROM f JOIN falls USING (market, side, hi, target) LEFT JOIN z USING (market, side, hi, target)"""


@query("x11_bisected_mde", _search_sql())
def x11b(spark, d):
    own, out = draws(spark, d), None
    for side, hi, target in SEARCHES:
        lower, upper, _ = SIDES_OF[side]
        nothing = F.lit(None).cast("double")
        rows = own.withColumn("lower", F.col("lower") if lower == "lower" else nothing).withColumn("upper", F.col("upper") if upper == "upper" else nothing)
        one = contract.minimum_detectable(rows, (0.0, hi), target, side=side)
        one = one.select("market", F.lit(side).alias("side"), F.lit(hi).alias("upper_bound"), F.lit(target).alias("target"), "reached", "monotone", r("mde_pct", 6).alias("mde_pct"), r("power", 6).alias("power"))
        out = one if out is None else out.unionByName(one)
    return out


# safety: regions by week, kinds of events by day, nations by month; a copy and a constant among the controls of two markets

GATED = f"""WITH wk AS ({WEEKS}), dy AS ({DAYS}), mo AS ({MONTHS}), p AS (SELECT 'weekly' AS frequency, region, date, kpi FROM wk UNION ALL SELECT 'daily', region, date, kpi FROM dy UNION ALL SELECT 'monthly', region, date, kpi FROM mo),
step AS (SELECT *, LAG(kpi) OVER (PARTITION BY frequency, region ORDER BY date) AS level FROM p), res AS (SELECT frequency || ':' || region AS market, date, kpi - level AS residual, level FROM step WHERE level IS NOT NULL),
series AS (SELECT frequency || ':' || region AS market, frequency, date FROM p), pairs AS (SELECT DISTINCT a.frequency, a.region AS own, b.region FROM (SELECT DISTINCT frequency, region FROM p) AS a JOIN (SELECT DISTINCT frequency, region FROM p) AS b ON a.frequency = b.frequency AND a.region <> b.region),
controls AS (SELECT pairs.frequency || ':' || own AS market, pairs.region, date, kpi FROM pairs JOIN p ON p.frequency = pairs.frequency AND p.region = pairs.region UNION ALL SELECT 'weekly:ASIA', 'copy of AFRICA', date, kpi FROM wk WHERE region = 'AFRICA' UNION ALL SELECT 'weekly:EUROPE', 'constant', date, 1.0 FROM wk WHERE region = 'AFRICA'),
one AS (SELECT market, region FROM controls GROUP BY 1, 2 HAVING ABS(MIN(kpi) - MAX(kpi)) <= 1e-8 + 1e-5 * ABS(MAX(kpi))), two AS (SELECT DISTINCT market, region FROM (SELECT a.market, a.region, b.region AS first FROM controls AS a JOIN controls AS b ON a.market = b.market AND a.date = b.date AND b.region < a.region GROUP BY 1, 2, 3 HAVING bool_and(ABS(a.kpi - b.kpi) <= 1e-8 + 1e-5 * ABS(b.kpi)))),
gone AS (SELECT market, region || ' (constant)' AS x FROM one UNION ALL SELECT market, region || ' (duplicate)' FROM two), n AS (SELECT market, ANY_VALUE(frequency) AS frequency, COUNT(DISTINCT date) AS n, MAX(date) - MIN(date) AS span FROM series GROUP BY 1),
c AS (SELECT n.market, (COUNT(DISTINCT region) - (SELECT COUNT(*) FROM gone WHERE gone.market = n.market))::INTEGER AS n_kept, COALESCE((SELECT string_agg(x, ', ' ORDER BY x) FROM gone WHERE gone.market = n.market), '') AS removed FROM n JOIN controls USING (market) GROUP BY 1),
h AS (SELECT n.*, n_kept, removed, CASE WHEN n_kept = 0 THEN 'no_informative_controls' WHEN n_kept + 1 > n THEN 'underdetermined' END AS fallback, COALESCE(span = (n - 1) * CASE frequency WHEN 'weekly' THEN 7 WHEN 'daily' THEN 1 END, false) AS contiguous FROM n JOIN c USING (market)),
lagged AS (SELECT *, LAG(residual) OVER (PARTITION BY market ORDER BY date) AS before FROM res), rho AS (SELECT market, GREATEST(LEAST(corr(before, residual), 0.99), -0.99) AS rho, COUNT(*) AS m FROM lagged GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY level, date) AS k, COUNT(*) OVER (PARTITION BY market) AS m, row_number() OVER (PARTITION BY market ORDER BY date) - 1 AS i, POWER(residual - AVG(residual) OVER (PARTITION BY market), 2) AS square FROM res),
v AS (SELECT market, MAX(m) AS m, var_samp(residual) FILTER (k > m - m // 2) / var_samp(residual) FILTER (k <= m // 2) AS ratio, corr(level, square) AS association FROM k GROUP BY 1),
blocks AS (SELECT market, i // 13 AS block, COUNT(*) AS size FROM k GROUP BY 1, 2), ordered AS (SELECT *, COALESCE(SUM(size) OVER (PARTITION BY market, resample ORDER BY md5('20260713:' || resample || ':' || block) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM blocks, range(1, 200) AS s(resample)),
null_ AS (SELECT o.market, o.resample, ABS(corr(l.level, k.square)) AS c FROM k JOIN ordered AS o ON o.market = k.market AND o.block = k.i // 13 JOIN k AS l ON l.market = k.market AND l.i = o.start + k.i - 13 * o.block GROUP BY 1, 2),
pv AS (SELECT market, (1 + COUNT(*) FILTER (c >= ABS(association) - 1e-12)) / 200 AS p_value FROM null_ JOIN v USING (market) GROUP BY 1)"""


@query("x13_safety_gates", f"""{GATED}, g AS (SELECT h.market, frequency, n, contiguous, n_kept, removed, fallback, rho, rho + 2 * SQRT(GREATEST(1 - rho * rho, 0) / m_rho) AS rho_upper, ratio, association, p_value, m FROM h LEFT JOIN (SELECT market, rho, m AS m_rho FROM rho) USING (market) LEFT JOIN v USING (market) LEFT JOIN pv USING (market)),
s AS (SELECT *, CASE frequency WHEN 'weekly' THEN 'supported' WHEN 'daily' THEN 'blocked' ELSE 'unsupported' END AS frequency_gate, CASE WHEN frequency <> 'weekly' THEN 'unsupported' WHEN n < 104 THEN 'blocked' WHEN NOT contiguous OR n < 10 * n_kept THEN 'supported_with_warning' ELSE 'supported' END AS history,
CASE WHEN fallback IS NOT NULL THEN 'supported' WHEN rho_upper >= 0.92 THEN 'blocked' WHEN rho >= 0.8 THEN 'supported_with_warning' ELSE 'supported' END AS persistence, CASE WHEN frequency = 'daily' THEN 'blocked' ELSE 'supported' END AS seasonality,
CASE WHEN fallback IS NOT NULL THEN 'supported' WHEN m IS NULL OR m < 8 THEN 'unsupported' WHEN ratio >= 2.3 OR ratio <= 1 / 2.3 OR p_value <= 0.05 AND ABS(association) >= 0.15 THEN 'blocked' ELSE 'supported' END AS heteroskedasticity, CASE WHEN fallback IS NOT NULL OR removed <> '' THEN 'supported_with_warning' ELSE 'supported' END AS control_matrix FROM g),
l AS (SELECT *, [frequency_gate, history, persistence, seasonality, heteroskedasticity, control_matrix] AS all_ FROM s)
SELECT market, n AS retained, n_kept, removed, ROUND(rho, 4) AS rho, ROUND(ratio, 4) AS ratio, ROUND(association, 4) AS association, ROUND(p_value, 6) AS p_value, frequency_gate, history, persistence, seasonality, heteroskedasticity, control_matrix,
CASE WHEN list_contains(all_, 'blocked') THEN 'blocked' WHEN list_contains(all_, 'unsupported') THEN 'unsupported' WHEN list_contains(all_, 'supported_with_warning') THEN 'supported_with_warning' ELSE 'supported' END AS overall FROM l""")
def x13b(spark, d):
    """Residuals are steps from one period to the next."""
    w, e, m = weeks(spark, d), sp.event_panel(spark, d), months(spark, d)
    p = written(w.select(F.lit("weekly").alias("frequency"), "region", "date", "kpi").unionByName(e.select(F.lit("daily").alias("frequency"), "region", "date", "kpi")).unionByName(m.select(F.lit("monthly").alias("frequency"), "region", "date", "kpi")))
    market = F.concat("frequency", F.lit(":"), "region")
    level = F.lag("kpi").over(Window.partitionBy("frequency", "region").orderBy("date"))
    residuals = p.withColumn("level", level).where("level is not null").select(market.alias("market"), "date", (F.col("kpi") - F.col("level")).alias("residual"), "level")
    names = p.select("frequency", "region").distinct()
    pairs = names.select("frequency", F.concat("frequency", F.lit(":"), "region").alias("market"), F.col("region").alias("own")).join(names, "frequency").where("own != region").select("frequency", "market", "region")
    controls = pairs.join(p, ["frequency", "region"]).select("market", "region", "date", "kpi")
    africa = p.where("frequency = 'weekly' and region = 'AFRICA'")
    controls = controls.unionByName(africa.select(F.lit("weekly:ASIA").alias("market"), F.lit("copy of AFRICA").alias("region"), "date", "kpi")).unionByName(africa.select(F.lit("weekly:EUROPE").alias("market"), F.lit("constant").alias("region"), "date", F.lit(1.0).alias("kpi")))
    x = contract.safety(p.select(market.alias("market"), "frequency", "date"), residuals, written(controls))
    return x.select("market", "retained", "n_kept", "removed", r("rho").alias("rho"), r("ratio").alias("ratio"), r("association").alias("association"), r("p_value", 6).alias("p_value"), *contract.GATES, "overall")


# the contract: a plan for each region and way in which a plan can fail

PLANS = f"""{LAGGED}, {REGION_KEYS}, c AS (SELECT n.region, kind, (SELECT list(region ORDER BY region) FROM n AS o WHERE o.region <> n.region) AS others FROM n, range(13) AS r(kind)),
a AS (SELECT *, CASE kind WHEN 3 THEN DATE '2000-05-01' WHEN 10 THEN DATE '1999-11-01' ELSE DATE '1995-01-02' END AS history_start, CASE kind WHEN 11 THEN DATE '2005-06-06' ELSE DATE '1999-12-27' END AS history_end FROM c),
b AS (SELECT *, list_transform(range(1, CASE kind WHEN 6 THEN 8 ELSE 9 END), lambda k: (history_end + (7 * (k + CASE kind WHEN 5 THEN 1 ELSE 0 END + CASE WHEN kind = 12 AND k > 4 THEN 1 ELSE 0 END))::INTEGER)::DATE) AS holdout FROM a),
plans AS (SELECT region || '-' || kind AS plan_id, CASE kind WHEN 4 THEN 'hourly' ELSE 'weekly' END AS frequency, [region] AS tests, CASE kind WHEN 1 THEN list_concat(others, [region]) WHEN 2 THEN list_concat(others, [others[1]]) ELSE others END AS controls, history_start, history_end, holdout,
list_transform(range(0, 8), lambda k: (CASE kind WHEN 7 THEN history_end ELSE history_end + 364 END + (7 * k)::INTEGER)::DATE) AS planned, 8 AS duration, CASE kind WHEN 9 THEN 1.5 ELSE 0.05 END::DOUBLE AS alpha, 0.8::DOUBLE AS target_power, 0.0::DOUBLE AS lower, 60.0::DOUBLE AS upper, 0.5::DOUBLE AS tolerance, CASE kind WHEN 8 THEN [5.0, 75.0] ELSE [5.0, 10.0] END::DOUBLE[] AS effects, 500 AS n_simulations, 52 AS min_periods, kind FROM b)"""
_DAYS = "list_transform(range(1, len({c})), lambda k: {c}[k + 1] - {c}[k])"


@query("x12_power_contract", f"""{PLANS}, regions AS (SELECT plan_id, UNNEST(list_distinct(list_concat(tests, controls))) AS region FROM plans), wanted AS (SELECT plan_id, COUNT(*) AS k FROM regions GROUP BY 1), full_ AS (SELECT plan_id, date FROM regions JOIN w USING (region) JOIN wanted USING (plan_id) GROUP BY plan_id, date, k HAVING COUNT(*) = k),
held AS (SELECT DISTINCT plan_id, UNNEST(holdout) AS date FROM plans), lacking AS (SELECT plan_id, string_agg(date::VARCHAR, ',' ORDER BY date) AS missing_holdout, COUNT(*) AS n_missing FROM held ANTI JOIN full_ USING (plan_id, date) GROUP BY 1),
x AS (SELECT p.*, COALESCE((SELECT COUNT(*) FROM full_ AS f WHERE f.plan_id = p.plan_id AND f.date BETWEEN history_start AND history_end), 0) AS n_history, COALESCE(n_missing, 0) AS n_missing, COALESCE(missing_holdout, '') AS missing_holdout,
list_filter([CASE WHEN alpha <= 0 OR alpha >= 1 THEN 'alpha_out_of_range' END, CASE WHEN len(list_filter(effects, lambda e: e < lower OR e > upper)) > 0 THEN 'effect_out_of_bounds' END, CASE WHEN history_start > history_end THEN 'history_reversed' END, CASE WHEN len(holdout) <> duration THEN 'holdout_count' END,
CASE WHEN frequency = 'weekly' AND holdout[1] - history_end <> 7 THEN 'holdout_not_adjacent' END, CASE WHEN frequency = 'weekly' AND len(list_filter({_DAYS.format(c='holdout')}, lambda k: k <> 7)) > 0 THEN 'holdout_with_gaps' END, CASE WHEN planned[1] <= holdout[-1] THEN 'planned_before_holdout_ends' END,
CASE WHEN list_has_any(tests, controls) THEN 'region_in_both_groups' END, CASE WHEN len(list_distinct(controls)) < len(controls) THEN 'region_repeated' END, CASE WHEN frequency <> 'weekly' THEN 'unknown_frequency' END], lambda b: b IS NOT NULL) AS blockers FROM plans AS p LEFT JOIN lacking USING (plan_id)),
s AS (SELECT *, list_filter([CASE WHEN n_history < min_periods THEN 'history_short' END, CASE WHEN n_missing > 0 THEN 'holdout_missing' END], lambda b: b IS NOT NULL) AS shortfalls FROM x)
SELECT plan_id, sha256(concat_ws('|', frequency, array_to_string(tests, ','), array_to_string(controls, ','), history_start, history_end, array_to_string(holdout, ','), array_to_string(planned, ','), duration, alpha, target_power, lower, upper, tolerance, array_to_string(effects, ','), n_simulations, min_periods)) AS fingerprint,
n_history, len(list_distinct(holdout)) - n_missing AS n_holdout, missing_holdout, array_to_string(blockers, ',') AS blockers, array_to_string(shortfalls, ',') AS shortfalls, CASE WHEN len(blockers) > 0 THEN 'blocked' WHEN len(shortfalls) > 0 THEN 'incomplete' ELSE 'completed' END AS status FROM s""")
def x12(spark, d):
    names = sp.table(spark, d, "region").select(F.trim("r_name").alias("region"))
    others = names.join(names.withColumnRenamed("region", "other"), F.col("region") != F.col("other")).groupBy("region").agg(F.array_sort(F.collect_list("other")).alias("others"))
    kind, day = F.col("kind"), lambda s: F.lit(s).cast("date")
    a = others.select("*", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("kind"))
    a = a.withColumn("history_start", F.when(kind == 3, day("2000-05-01")).when(kind == 10, day("1999-11-01")).otherwise(day("1995-01-02"))).withColumn("history_end", F.when(kind == 11, day("2005-06-06")).otherwise(day("1999-12-27")))
    late = F.when(kind == 5, 1).otherwise(0)
    held = F.transform(F.sequence(F.lit(1), F.when(kind == 6, 7).otherwise(8)), lambda k: F.date_add("history_end", 7 * (k + late + F.when((kind == 12) & (k > 4), 1).otherwise(0))))
    planned = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.date_add(F.when(kind == 7, F.col("history_end")).otherwise(F.date_add("history_end", 364)), 7 * k))
    one = F.array("region")
    plans = a.select(
        F.concat("region", F.lit("-"), kind.cast("string")).alias("plan_id"), F.when(kind == 4, "hourly").otherwise("weekly").alias("frequency"), one.alias("tests"),
        F.when(kind == 1, F.concat("others", one)).when(kind == 2, F.concat("others", F.slice("others", 1, 1))).otherwise(F.col("others")).alias("controls"), "history_start", "history_end", held.alias("holdout"), planned.alias("planned"), F.lit(8).alias("duration"),
        F.when(kind == 9, 1.5).otherwise(0.05).alias("alpha"), F.lit(0.8).alias("target_power"), F.lit(0.0).alias("lower"), F.lit(60.0).alias("upper"), F.lit(0.5).alias("tolerance"), F.when(kind == 8, F.array(F.lit(5.0), F.lit(75.0))).otherwise(F.array(F.lit(5.0), F.lit(10.0))).alias("effects"), F.lit(500).alias("n_simulations"), F.lit(52).alias("min_periods"),
    )
    return contract.power_contract(plans, weeks(spark, d))


# posterior: chains of two parameters from the weekly panel, draws of a model of two terms from all suppliers

CHAINS = f"""{LAGGED}, v AS (SELECT 'kpi' AS parameter, region AS chain, date AS draw, kpi AS value FROM w UNION ALL SELECT 'orders', region, date, orders FROM w UNION ALL SELECT 'steps', region, date, kpi - LAG(kpi) OVER (PARTITION BY region ORDER BY date) FROM w),
i AS (SELECT *, row_number() OVER (PARTITION BY parameter, chain ORDER BY draw) - 1 AS i FROM v WHERE value IS NOT NULL), n AS (SELECT parameter, MIN(n)::BIGINT AS n FROM (SELECT parameter, chain, COUNT(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT parameter, chain || CASE WHEN i >= n - n // 2 THEN '.2' ELSE '.1' END AS chain, CASE WHEN i >= n - n // 2 THEN i - n + n // 2 ELSE i END AS i, value FROM i JOIN n USING (parameter) WHERE i < n AND (i >= n - n // 2 OR i < n // 2)),
e AS (SELECT parameter, chain, AVG(value) AS m, var_samp(value) AS v, COUNT(*) AS n FROM c GROUP BY 1, 2), o AS (SELECT parameter, COUNT(*) AS n_chains, MAX(n) AS n_draws, AVG(v) AS w, var_samp(m) AS b, AVG(v) * (MAX(n) - 1) / MAX(n) + var_samp(m) AS plus FROM e GROUP BY 1),
d AS (SELECT c.parameter, c.chain, c.i, value - m AS d, n FROM c JOIN e USING (parameter, chain)), a AS (SELECT parameter, lag, AVG(a) AS acov FROM (SELECT x.parameter, x.chain, y.i - x.i AS lag, SUM(x.d * y.d) / MAX(x.n) AS a FROM d AS x JOIN d AS y ON x.parameter = y.parameter AND x.chain = y.chain AND y.i >= x.i GROUP BY 1, 2, 3) GROUP BY 1, 2),
rho AS (SELECT parameter, lag, CASE WHEN lag = 0 THEN 1.0 ELSE 1 - (w - acov) / plus END AS rho FROM a JOIN o USING (parameter)), p AS (SELECT parameter, lag // 2 AS k, SUM(rho) AS p FROM rho GROUP BY 1, 2 HAVING COUNT(*) = 2), l AS (SELECT parameter, MIN(p) OVER (PARTITION BY parameter ORDER BY k) AS least FROM p),
tau AS (SELECT parameter, 2 * SUM(least) - 1 AS tau FROM l WHERE least >= 0 GROUP BY 1), s AS (SELECT parameter, stddev_samp(value) AS sd FROM c GROUP BY 1), f AS (SELECT *, n_chains * n_draws / GREATEST(tau, 1 / log10(n_chains * n_draws)) AS ess, SQRT(plus / w) AS r_hat FROM o JOIN s USING (parameter) JOIN tau USING (parameter))"""


def chains(spark, d):
    w = weeks(spark, d).withColumn("step", F.col("kpi") - F.lag("kpi").over(Window.partitionBy("region").orderBy("date")))
    each = (F.struct(F.lit(n).alias("parameter"), F.col("region").alias("chain"), F.col("date").alias("draw"), F.col(c).cast("double").alias("value")) for n, c in (("kpi", "kpi"), ("orders", "orders"), ("steps", "step")))
    return w.select(F.explode(F.array(*each)).alias("x")).select("x.*")


@query("a23_effective_sizes", f"{CHAINS} SELECT parameter, n_chains, n_draws, ROUND(sd, 2) AS sd, ROUND(r_hat, 4) AS r_hat, ROUND(ess, 2) AS ess, ROUND(sd / SQRT(ess), 2) AS mcse, ROUND(1 / SQRT(ess), 4) AS mcse_ratio, r_hat <= 1.01 AS r_hat_ok, ess >= 500 AS ess_ok, 1 / SQRT(ess) < 0.10 AS mcse_ok FROM f")
def a23b(spark, d):
    x = posterior.convergence(chains(spark, d))
    return x.select("parameter", "n_chains", "n_draws", r("sd", 2).alias("sd"), r("r_hat").alias("r_hat"), r("ess", 2).alias("ess"), r("mcse", 2).alias("mcse"), r("mcse_ratio").alias("mcse_ratio"), "r_hat_ok", "ess_ok", "mcse_ok")


@query("a23_convergence_summary", f"{CHAINS} SELECT ROUND(MAX(r_hat), 4) AS max_r_hat, ROUND(MIN(ess), 2) AS min_ess, ROUND(MAX(1 / SQRT(ess)), 4) AS max_mcse_ratio, bool_and(r_hat <= 1.01 AND ess >= 500 AND 1 / SQRT(ess) < 0.10) AS ok, 0 AS n_divergences FROM f")
def a23c(spark, d):
    x = posterior.convergence_summary(posterior.convergence(chains(spark, d)), 0)
    return x.select(r("max_r_hat").alias("max_r_hat"), r("min_ess", 2).alias("min_ess"), r("max_mcse_ratio").alias("max_mcse_ratio"), "ok", "n_divergences")


@query("a22_period_intervals", f"""{LAGGED}, {REGION_KEYS}, p AS (SELECT date, MAX(kpi) FILTER (k = 0) AS actual, MAX(kpi) FILTER (k = 1) AS x1, MAX(kpi) FILTER (k = 2) AS x2 FROM w JOIN n USING (region) GROUP BY 1), q AS (SELECT * FROM p WHERE actual IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
v AS (SELECT date, actual, s_acctbal::DOUBLE * 10 + s_nationkey / 25.0::DOUBLE * x1 + (s_suppkey % 7) / 7.0::DOUBLE * x2 AS v FROM q, supplier) SELECT date, ROUND(actual, 2) AS actual, ROUND(AVG(v), 2) AS fitted, ROUND(quantile_cont(v, 0.03), 2) AS lower, ROUND(quantile_cont(v, 0.97), 2) AS upper, ROUND(AVG(CASE WHEN actual > v THEN 1.0 ELSE 0.0 END), 6) AS p_positive FROM v GROUP BY date, actual""")
def a22(spark, d):
    w = weeks(spark, d).join(F.broadcast(sp.table(spark, d, "region").select(F.trim("r_name").alias("region"), F.col("r_regionkey").alias("k"))), "region")  # 5 rows
    of = lambda k: F.max(F.when(F.col("k") == k, F.col("kpi")))
    periods = w.groupBy("date").agg(of(0).alias("actual"), of(1).alias("x1"), of(2).alias("x2")).dropna().select("date", "actual", F.array("x1", "x2").alias("x"))
    draws_ = sp.table(spark, d, "supplier").select((F.col("s_acctbal").cast("double") * 10).alias("intercept"), F.array(F.col("s_nationkey") / 25.0, F.col("s_suppkey") % 7 / 7.0).alias("coef"))
    x = posterior.period_intervals(draws_, periods)
    return x.select("date", *(r(c, 2).alias(c) for c in ("actual", "fitted", "lower", "upper")), r("p_positive", 6).alias("p_positive"))


SHAPE = f"""history AS (SELECT * FROM w WHERE date <= DATE '{PRE_END}'), shape AS (SELECT region, date, kpi / AVG(kpi) OVER (PARTITION BY region) * 100 AS v FROM history),
far AS (SELECT t.region AS market, c.region, SQRT(AVG(POWER(c.v - t.v, 2))) AS distance FROM shape AS t JOIN shape AS c ON c.date = t.date AND c.region <> t.region GROUP BY 1, 2), close AS (SELECT t.region AS market, c.region, ABS(corr(t.kpi, c.kpi)) AS r FROM history AS t JOIN history AS c ON c.date = t.date AND c.region <> t.region GROUP BY 1, 2),
bounds AS (SELECT market, GREATEST(0.05, median(r) / 4) AS lo, LEAST(2.0, median(r) * 1.25) AS hi FROM close GROUP BY 1), sim AS (SELECT *, 1 / (1 + distance) AS similarity FROM far), ends AS (SELECT market, MIN(similarity) AS a, MAX(similarity) AS b FROM sim GROUP BY 1)"""


def priors(spark, d):
    """Every region's controls with a sigma by the likeness of their shapes in the history, and the same for their lagged terms."""
    w = weeks(spark, d).where(F.col("date") <= F.lit(PRE_END).cast("date"))
    shape = w.withColumn("v", F.col("kpi") / F.avg("kpi").over(Window.partitionBy("region")) * 100)
    own, other = shape.select(F.col("region").alias("market"), "date", F.col("v").alias("t")), shape.select("region", "date", "v")
    far = own.join(other, "date").where("market != region").groupBy("market", "region").agg(F.sqrt(F.avg(F.pow(F.col("v") - F.col("t"), 2))).alias("distance"))
    everything = runs(spark, d).where("method = 'all'")
    sigmas = posterior.structural_sigmas(far, posterior.correlation_bounds(w, everything))
    return posterior.prior_table(keyed.term_labels(everything, LAGS), sigmas)


@query("b3_prior_table", f"""{LAGGED}, {SHAPE} SELECT market, CASE lag WHEN 0 THEN region ELSE region || '_lag1' END AS feature, region, CASE lag WHEN 0 THEN 'Same week' ELSE 'Lag 1 week' END AS term, ROUND(distance, 4) AS distance, ROUND(similarity, 4) AS similarity, ROUND(lo + (hi - lo) * (similarity - a) / (b - a), 4) AS sigma, 'structural' AS kind FROM sim JOIN ends USING (market) JOIN bounds USING (market) CROSS JOIN (VALUES (0), (1)) AS l(lag)""")
def b3(spark, d):
    return rounded(priors(spark, d))


# records: an experiment for each customer, a stage's inputs changed by rules on balance and segment

STAGES = ("match", "validation", "power", "delivery", "effect", "recommendation")
RECORDS = f"""st AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{s}')" for k, s in enumerate(STAGES))}) AS s(k, stage)),
r AS (SELECT c_custkey AS experiment, stage, k, CASE WHEN k > c_nationkey % 7 THEN 'not_started' WHEN c_acctbal > 5000 AND k = 3 THEN 'stale' ELSE 'completed' END AS status, CASE WHEN k > c_nationkey % 7 THEN NULL ELSE md5(c_custkey || stage) END AS stored,
CASE WHEN c_acctbal < 0 AND k = c_nationkey % 3 THEN md5(c_custkey || stage || 'x') WHEN c_custkey % 5 = 0 AND k = 0 THEN '' ELSE md5(c_custkey || stage) END AS current FROM customer, st)"""


@query("d9_staleness", f"""WITH RECURSIVE {RECORDS}, own AS (SELECT *, status <> 'not_started' AND stored IS NOT NULL AND current <> '' AND stored <> current AS own_change FROM r), m AS (SELECT experiment, k FROM own WHERE own_change UNION SELECT experiment, k + 1 FROM m WHERE k < 5),
x AS (SELECT *, status <> 'not_started' AND stored IS NOT NULL AND EXISTS (SELECT 1 FROM m WHERE m.experiment = own.experiment AND m.k = own.k) AS stale FROM own), y AS (SELECT *, CASE WHEN stale THEN 'stale' WHEN status = 'stale' AND stored IS NOT NULL THEN 'completed' ELSE status END AS new_status FROM x)
SELECT experiment, stage, status, own_change, stale, new_status, new_status <> status AS changed FROM y""")
def d9(spark, d):
    c = sp.table(spark, d, "customer").select("*", F.posexplode(F.array(*map(F.lit, STAGES))).alias("k", "stage"))
    later = F.col("k") > F.col("c_nationkey") % 7
    name = F.concat(F.col("c_custkey").cast("string"), "stage")
    status = F.when(later, "not_started").when((F.col("c_acctbal") > 5000) & (F.col("k") == 3), "stale").otherwise("completed")
    current = F.when((F.col("c_acctbal") < 0) & (F.col("k") == F.col("c_nationkey") % 3), F.md5(F.concat(name, F.lit("x")).cast("binary"))).when((F.col("c_custkey") % 5 == 0) & (F.col("k") == 0), "").otherwise(F.md5(name.cast("binary")))
    stages = c.select(F.col("c_custkey").alias("experiment"), "stage", status.alias("status"), F.when(~later, F.md5(name.cast("binary"))).alias("stored"), current.alias("current"))
    return lineage.staleness(stages, lineage.stage_edges(spark), written).select("experiment", "stage", "status", "own_change", "stale", "new_status", "changed")


_DOC = "json_object('id', o_orderkey, 'periods', json_object('start', o_orderdate::VARCHAR, 'regions', json_array(o_custkey {a}, o_orderstatus)), 'priority', {b}, 'post', {c}, 'empty', json_array() {more})"
DOCS = f"SELECT o_orderkey AS key, {_DOC.format(a='', b='o_orderpriority', c='true', more='')}::JSON AS planned, {_DOC.format(a='+ o_orderkey % 2', b='''CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey::JSON ELSE to_json(o_orderpriority) END''', c='o_orderkey % 4 = 0', more=', ' + repr('note') + ', NULL')}::JSON AS analysed FROM orders"


@query("j16_compared_records", f"""WITH d AS ({DOCS}), flat AS (SELECT d.key AS record, 'p' AS side, t.* FROM d, json_tree(d.planned) AS t UNION ALL SELECT d.key, 'a', t.* FROM d, json_tree(d.analysed) AS t),
leaf AS (SELECT record AS key, side, replace(fullkey, '"', '') AS path, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS type, CASE type WHEN 'VARCHAR' THEN value ->> '$' WHEN 'NULL' THEN NULL WHEN 'ARRAY' THEN NULL ELSE value::VARCHAR END AS value FROM flat WHERE NOT (type = 'OBJECT' OR type = 'ARRAY' AND value::VARCHAR <> '[]')),
x AS (SELECT COALESCE(p.key, a.key) AS key, COALESCE(p.path, a.path) AS path, CASE WHEN p.key IS NULL THEN 'only_analysed' WHEN a.key IS NULL THEN 'only_planned' WHEN p.type = a.type AND p.value IS NOT DISTINCT FROM a.value THEN 'same' ELSE 'changed' END AS state FROM (SELECT * FROM leaf WHERE side = 'p') AS p FULL JOIN (SELECT * FROM leaf WHERE side = 'a') AS a ON p.key = a.key AND p.path = a.path)
SELECT key, bool_and(state = 'same') AS matches, COUNT(*) FILTER (state = 'same') AS n_same, COUNT(*) FILTER (state = 'changed') AS n_changed, COUNT(*) FILTER (state = 'only_planned') AS n_only_planned, COUNT(*) FILTER (state = 'only_analysed') AS n_only_analysed, COALESCE(string_agg(path, ',' ORDER BY path) FILTER (state <> 'same'), '') AS differences FROM x GROUP BY 1""")
def j16(spark, d):
    o = sp.table(spark, d, "orders")
    k = F.col("o_orderkey")

    def doc(first, priority, post, *more):
        name = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        periods = F.concat(F.lit('{"start":'), name(F.to_date("o_orderdate").cast("string")), F.lit(',"regions":['), first.cast("string"), F.lit(","), name(F.col("o_orderstatus")), F.lit("]}"))
        return F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"periods":'), periods, F.lit(',"priority":'), priority, F.lit(',"post":'), post.cast("string"), F.lit(',"empty":[]'), *more, F.lit("}"))

    quoted = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))
    planned = o.select(k.alias("key"), doc(F.col("o_custkey"), quoted, F.lit(True)).alias("doc"))
    analysed = o.select(k.alias("key"), doc(F.col("o_custkey") + k % 2, F.when(k % 3 == 0, k.cast("string")).otherwise(quoted), k % 4 == 0, F.lit(',"note":null')).alias("doc"))
    return lineage.record_comparison(planned, analysed)


@query("m2_scored_arrays", f"""WITH {LONGF}, {STATS}, {TEST_SQL}, tp AS (SELECT feature, SUM(value * population) / SUM(population) AS t FROM lf SEMI JOIN t USING (region) GROUP BY 1), pool AS (SELECT DISTINCT region FROM lf ANTI JOIN t USING (region)),
g AS (SELECT a.region || '+' || b.region AS group_id, a.region AS a, b.region AS b FROM pool AS a JOIN pool AS b ON a.region < b.region), cp AS (SELECT group_id, feature, SUM(value * population) / SUM(population) AS c FROM g JOIN lf ON lf.region = g.a OR lf.region = g.b GROUP BY 1, 2)
SELECT group_id, ROUND(SQRT(SUM(POWER((t - c) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 2))), 4) AS distance, ROUND(AVG(CASE WHEN sd > 0 THEN ABS(t - c) / sd END), 4) AS mean_abs_smd FROM cp JOIN tp USING (feature) JOIN st USING (feature) GROUP BY 1""")
def m2(spark, d):
    """All pairs of the pool's regions as candidate groups."""
    long, test = long_features(spark, d), test_regions(spark, d)
    pool = matching.member_numbers(long).join(test, "region", "left_anti")
    other = pool.select(F.col("region").alias("b"), F.col("number").alias("second"))
    groups = pool.join(other, F.col("region") < F.col("b")).select(F.concat("region", F.lit("+"), "b").alias("group_id"), F.array("number", "second").alias("members"))  # the candidates themselves
    return rounded(matching.score_arrays(groups, long, test).drop("members"))
