"""Matching of control regions: profiles, distances, nearest regions, guided test groups, and searches over groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def weighted_means(df: DataFrame, by: list[str], features: list[str], weight: str) -> DataFrame:
    """Weighted mean of each feature by group, over the rows that have it; a group without weight has none. Also the weight."""
    own = [F.try_divide(F.sum(F.when(F.col(f).isNotNull(), F.col(f) * F.col(weight))), F.nullif(F.sum(F.when(F.col(f).isNotNull(), F.col(weight))), F.lit(0.0))).alias(f) for f in features]
    return df.groupBy(*by).agg(F.sum(weight).alias(weight), *own)


def profile(df: DataFrame, features: list[str], weight: str) -> DataFrame:
    """One row: the weighted mean of each feature, or the plain one if the weights come to nothing."""
    return df.agg(*(F.when(F.sum(weight) > 0, F.try_divide(F.sum(F.col(f) * F.col(weight)), F.sum(weight))).otherwise(F.avg(f)).alias(f) for f in features))


def impute(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing features become the median of the others, or 0 if there is none."""
    medians = df.agg(*(F.coalesce(F.median(f), F.lit(0.0)).alias(f"med_{f}") for f in features))
    return df.join(F.broadcast(medians)).select(*(F.coalesce(f, f"med_{f}").alias(f) if f in features else F.col(f) for f in df.columns))  # one row


def long_features(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    return df.unpivot(keys, features, "feature", "value")


def structural_stats(long: DataFrame) -> DataFrame:
    """Mean and population deviation of each feature over the eligible regions."""
    return long.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))


def score_groups(groups: DataFrame, long: DataFrame, test: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """group_id, distance and mean_abs_smd of every group of control regions.

    groups: group_id, region; long: region, population, feature, value (imputed), of all eligible regions; test: region. The
    distance is the root of the weighted sum of squared differences of population-weighted profiles in pool deviations; a
    feature without spread counts at scale 1 in it, and not at all in the mean difference.
    """
    prof = lambda d, by: d.groupBy(*by, "feature").agg(F.when(F.sum("population") > 0, F.sum(F.col("value") * F.col("population")) / F.sum("population")).otherwise(F.avg("value")).alias("p"))
    t = prof(long.join(test.select("region").distinct(), "region", "left_semi"), []).withColumnRenamed("p", "t")
    c = prof(groups.join(long, "region"), ["group_id"]).withColumnRenamed("p", "c")
    stats = structural_stats(long)
    both = c.join(t.join(stats, "feature"), "feature")
    w = F.lit(1.0)
    for f, x in (weights or {}).items():
        w = F.when(F.col("feature") == f, F.lit(float(x))).otherwise(w)
    scale = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    z = (F.col("t") - F.col("c")) / scale
    smd = F.when(F.col("sd") > 0, F.abs(F.col("t") - F.col("c")) / F.col("sd"))
    return both.groupBy("group_id").agg(F.sqrt(F.sum(w * z * z)).alias("distance"), F.avg(smd).alias("mean_abs_smd"))


def member_numbers(long: DataFrame) -> DataFrame:
    """region, number: the eligible regions in order of label, from 0; ``score_arrays`` takes these numbers."""
    return long.select("region").distinct().withColumn("number", (F.row_number().over(Window.orderBy("region")) - 1).cast("int"))  # regions of one experiment


def score_arrays(groups: DataFrame, long: DataFrame, test: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """groups with distance and mean_abs_smd, as ``score_groups`` gives them, of groups held as arrays of numbers (members).

    The matrix of eligible regions and features is one experiment's, and goes to the tasks once; a batch of groups is scored by
    sums over its flattened members. An empty group has neither figure.
    """
    numbered = long.join(member_numbers(long), "region")
    cells = numbered.select("number", "feature", "population", "value").collect()  # regions x features of one experiment
    features = sorted({r["feature"] for r in cells})
    n = 1 + max((r["number"] for r in cells), default=-1)
    x, pop = np.zeros((n, len(features))), np.zeros(n)
    for r in cells:
        x[r["number"], features.index(r["feature"])], pop[r["number"]] = r["value"], r["population"]
    own = [r["number"] for r in member_numbers(long).join(test.select("region").distinct(), "region", "left_semi").collect()]
    p = pop[own]
    t = (x[own] * p[:, None]).sum(0) / p.sum() if p.sum() > 0 else x[own].mean(0)
    sd, w = x.std(0), np.array([float((weights or {}).get(f, 1.0)) for f in features])
    held = groups.sparkSession.sparkContext.broadcast((x, pop, t, sd, w))

    @F.pandas_udf("distance double, mean_abs_smd double")
    def score(members: pd.Series) -> pd.DataFrame:
        x, pop, t, sd, w = held.value
        sizes = members.map(len).to_numpy()
        out = pd.DataFrame({"distance": np.full(len(members), np.nan), "mean_abs_smd": np.full(len(members), np.nan)})
        full = np.flatnonzero(sizes)
        if len(full):
            flat, at = np.concatenate(members.iloc[full].to_list()).astype(int), np.r_[0, np.cumsum(sizes[full])[:-1]]
            mass = np.add.reduceat(pop[flat], at)
            weighted, plain = np.add.reduceat(x[flat] * pop[flat, None], at), np.add.reduceat(x[flat], at) / sizes[full, None]
            c = np.where(mass[:, None] > 0, weighted / np.where(mass > 0, mass, 1)[:, None], plain)
            spread = sd > 0
            out.loc[full, "distance"] = np.sqrt((w * ((t - c) / np.where(spread, sd, 1)) ** 2).sum(1))
            if spread.any():
                out.loc[full, "mean_abs_smd"] = (np.abs(t - c)[:, spread] / sd[spread]).mean(1)
        return out.astype(object).where(out.notna(), None)

    return groups.withColumn("quadrat_s", score("members")).select(*groups.columns, F.col("quadrat_s.distance").alias("distance"), F.col("quadrat_s.mean_abs_smd").alias("mean_abs_smd"))


def balance_table(long: DataFrame, test: DataFrame, control: DataFrame) -> DataFrame:
    """By feature: profiles of test and control, difference, standardised difference and squared contribution."""
    prof = lambda d, name: d.groupBy("feature").agg((F.sum(F.col("value") * F.col("population")) / F.sum("population")).alias(name))
    t = prof(long.join(test, "region", "left_semi"), "test_mean")
    c = prof(long.join(control, "region", "left_semi"), "control_mean")
    x = t.join(c, "feature").join(structural_stats(long), "feature")
    d = F.col("test_mean") - F.col("control_mean")
    return x.select("feature", "test_mean", "control_mean", d.alias("difference"), F.when(F.col("sd") > 0, F.abs(d) / F.col("sd")).alias("abs_smd"), F.pow(d / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0), 2).alias("contribution"))


def nearest(long: DataFrame, test: DataFrame, n: int) -> DataFrame:
    """The n pool regions nearest to the test profile, ties by label."""
    pool = long.select("region").distinct().join(test.select("region").distinct(), "region", "left_anti")
    return score_groups(pool.select(F.col("region").alias("group_id"), "region"), long, test).orderBy("distance", "group_id").limit(n)


def match_results(members: DataFrame, long: DataFrame, test: DataFrame, seed: int | None = None) -> DataFrame:
    """A row for each strategy: its best group of controls, how it balances, and the way to it.

    members: strategy, place (the order in which groups were tried), group_id, region. Columns: strategy, controls (array of
    labels), distance, mean_abs_smd, smds (array of feature and abs_smd, by feature; null for a feature without spread),
    candidates (groups tried), convergence (distances that beat all before them, in order) and seed. Ties go to the smaller
    group_id; members that aren't in ``long`` count for nothing, and a strategy without a scored group has no row.
    """
    groups = members.groupBy("strategy", "group_id").agg(F.min("place").alias("place"))
    rows = members.select(F.struct("strategy", "group_id").alias("group_id"), "region").distinct()
    scored = score_groups(rows, long, test).select("group_id.*", "distance", "mean_abs_smd").where("distance is not null").join(groups, ["strategy", "group_id"])
    before = Window.partitionBy("strategy").orderBy("place", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    told = scored.withColumn("so_far", F.min("distance").over(before))
    gain = F.when(F.col("so_far").isNull() | (F.col("distance") < F.col("so_far")), F.struct("place", "group_id", "distance"))
    best = told.groupBy("strategy").agg(
        F.min_by(F.struct("group_id", "distance", "mean_abs_smd"), F.struct("distance", "group_id")).alias("b"), F.count("*").alias("candidates"), F.array_sort(F.collect_list(gain)).alias("steps")
    ).select("strategy", "b.*", "candidates", F.transform("steps", lambda s: s["distance"]).alias("convergence"))
    own = best.select("strategy", "group_id").join(members.select("strategy", "group_id", "region").distinct(), ["strategy", "group_id"])
    controls = own.join(long.select("region").distinct(), "region", "left_semi").groupBy("strategy").agg(F.array_sort(F.collect_set("region")).alias("controls"))
    mean = F.coalesce(F.try_divide(F.sum(F.col("value") * F.col("population")), F.sum("population")), F.avg("value"))
    sides = long.join(test.select("region").distinct(), "region", "left_semi").groupBy("feature").agg(mean.alias("t")).join(structural_stats(long), "feature")
    each = own.join(long, "region").groupBy("strategy", "feature").agg(mean.alias("c")).join(sides, "feature")
    smds = each.groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct("feature", F.when(F.col("sd") > 0, F.abs(F.col("t") - F.col("c")) / F.col("sd")).alias("abs_smd")))).alias("smds"))
    return best.join(controls, "strategy").join(smds, "strategy").select("strategy", "controls", "distance", "mean_abs_smd", "smds", "candidates", "convergence", F.lit(seed).cast("int").alias("seed"))


def index_to_100(panel: DataFrame) -> DataFrame:
    """kpi as percent of its region's mean."""
    return panel.withColumn("indexed", F.try_divide("kpi", F.avg("kpi").over(Window.partitionBy("region"))) * 100)


def retained_regions(panel: DataFrame) -> DataFrame:
    """Regions with a value on every date of the panel and a positive sum."""
    n = panel.select("date").distinct().agg(F.count("*").alias("n_dates"))
    own = panel.groupBy("region").agg(F.count("kpi").alias("k"), F.sum("kpi").alias("volume"))
    return own.join(F.broadcast(n)).where("k = n_dates and volume > 0").select("region", "volume")  # one row


#: Up to so many candidates all subsets are tried; beyond it, so many random ones of a seed.
EXHAUSTIVE, RANDOM_SUBSETS = 16, 2000


def _draw(*parts: Column | str) -> Column:
    """A number of 32 bits from the md5 of the parts, which SQL elsewhere can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def candidate_subsets(spark: SparkSession, names: list[str], seed: int = 0, exhaustive: int = EXHAUSTIVE, tries: int = RANDOM_SUBSETS) -> DataFrame:
    """subset, region: all subsets of up to ``exhaustive`` candidates, else ``tries`` random ones: a size of 0 to all, and so many of
    the candidates in a random order. The empty subset has no row."""
    n = len(names)
    if not n:
        return spark.createDataFrame([], "subset long, region string")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("bit"), F.lit(r).alias("region")) for k, r in enumerate(sorted(names)))))
    if n <= exhaustive:
        rows = spark.range(2**n).select(F.col("id").alias("subset"), each.alias("x")).where(F.pmod(F.floor(F.col("subset") / F.pow(F.lit(2), F.col("x.bit"))), F.lit(2)) == 1)
        return rows.select("subset", "x.region")
    rows = spark.range(tries).select(F.col("id").alias("subset"), each.alias("x"))
    s = F.concat_ws(":", F.lit(str(seed)), F.col("subset").cast("string"))
    place = F.row_number().over(Window.partitionBy("subset").orderBy(_draw(s, F.col("x.region")), "x.region"))
    return rows.withColumn("place", place).where(F.col("place") <= F.pmod(_draw(s), F.lit(n + 1))).select("subset", "x.region")


def guided_test_group(regions: DataFrame, target: float, tolerance: float, forced: list[str] = (), barred: list[str] = (), seed: int = 0, exhaustive: int = EXHAUSTIVE) -> DataFrame:
    """The subset of candidate regions whose share of population comes nearest to the band target +- tolerance (percent).

    Subsets are those of ``candidate_subsets`` and the forced regions alone. Distance to the band counts first, then distance to
    the target, fewer members, and the order of labels. regions: region, population, a row for each region. A forced region that
    isn't there leaves an empty group.
    """
    sizes = regions.groupBy("region").agg(F.sum("population").cast("double").alias("p"))
    total = sizes.agg(F.sum("p").alias("total"))
    known = [r["region"] for r in sizes.select("region").collect()]  # the regions of one experiment
    if set(forced) - set(known):
        return regions.sparkSession.createDataFrame([("", 0.0, False)], "test_group string, share double, met boolean")
    picked = candidate_subsets(regions.sparkSession, [r for r in known if r not in {*forced, *barred}], seed, exhaustive)
    fixed = sizes.where(F.col("region").isin(*forced) if forced else F.lit(False))
    base = fixed.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("base"), F.array_sort(F.collect_list("region")).alias("forced"))
    # populations add up in the order of labels, so that a share doesn't depend on the order of rows
    groups = picked.join(F.broadcast(sizes), "region").groupBy("subset").agg(F.array_sort(F.collect_list(F.struct("region", "p"))).alias("m"))  # regions of one experiment
    alone = regions.sparkSession.range(1).select(F.lit(-1).cast("long").alias("subset"), F.array().cast("array<struct<region:string,p:double>>").alias("m"))
    scored = groups.unionByName(alone).join(F.broadcast(total)).join(F.broadcast(base))  # single rows
    held = F.col("base") + F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x["p"])
    share = F.coalesce(F.try_divide(held, F.col("total")), F.lit(0.0))  # no regions, no people: a share of 0
    lo, hi = max(0.0, target - tolerance) / 100, min(100.0, target + tolerance) / 100
    band = F.when(F.col("share").between(lo, hi), 0.0).otherwise(F.least(F.abs(F.col("share") - lo), F.abs(F.col("share") - hi)))
    label = F.array_sort(F.concat("forced", F.transform("m", lambda x: x["region"])))
    out = scored.select(label.alias("group"), share.alias("share")).withColumn("dist", band)
    return out.select("group", "share", "dist", F.abs(F.col("share") - target / 100).alias("off")).orderBy("dist", "off", F.size("group"), "group").limit(1).select(F.array_join("group", ", ").alias("test_group"), "share", (F.col("dist") == 0).alias("met"))


def constraint_conflicts(fields: DataFrame) -> DataFrame:
    """region, fields: regions whose assignments (region, field) contradict each other."""
    own = fields.groupBy("region").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    has = lambda *x: both_in(F.col("fields"), *x)
    bad = (F.array_contains("fields", "exclude_from_both") & (F.size("fields") > 1)) | has("force_test_include", "force_control_include") | has("force_test_include", "test_only_exclude") | has("force_control_include", "control_only_exclude")
    return own.where(bad).select("region", F.array_join("fields", ",").alias("fields"))


def both_in(array: Column, a: str, b: str) -> Column:
    return F.array_contains(array, a) & F.array_contains(array, b)


# searches over groups: one task a pool size, so that sizes run side by side

def _distance(z: np.ndarray, pop: np.ndarray, t: np.ndarray, w: np.ndarray, idx) -> float:
    p = pop[idx]
    c = (z[idx] * p[:, None]).sum(0) / p.sum() if p.sum() > 0 else z[idx].mean(0)
    return float(np.sqrt((w * (t - c) ** 2).sum()))


def hill_climb(z, pop, t, w, n: int, swaps: int = 15) -> tuple[list[int], float]:
    """From the n nearest, swap the pair that gains most until none gains."""
    order = np.lexsort((np.arange(len(z)), ((z - t) ** 2 * w).sum(1)))
    group, spare = list(order[:n]), list(order[n : n + swaps])
    score = _distance(z, pop, t, w, group)
    while spare:
        best = min(((_distance(z, pop, t, w, [*group[:j], s, *group[j + 1 :]]), j, k) for j in range(len(group)) for k, s in enumerate(spare)), default=None)
        if best is None or best[0] >= score:
            break
        score = best[0]
        group[best[1]] = spare.pop(best[2])
    return group, score


def stochastic_search(z, pop, t, w, n: int, rounds: int = 1000, seed: int = 42) -> tuple[list[int], float]:
    """Random swaps from the n nearest; only gains are kept."""
    rng = np.random.default_rng([seed, n])
    group = list(np.lexsort((np.arange(len(z)), ((z - t) ** 2 * w).sum(1)))[:n])
    score = _distance(z, pop, t, w, group)
    for _ in range(rounds):
        rest = np.setdiff1d(np.arange(len(z)), group)
        if not len(rest):
            break
        trial = list(group)
        trial[rng.integers(n)] = int(rng.choice(rest))
        s = _distance(z, pop, t, w, trial)
        if s < score:
            group, score = trial, s
    return group, score


def pool_sweep(spark: SparkSession, pool: DataFrame, test: DataFrame, features: list[str], sizes: list[int], strategy: str = "hill_climb") -> DataFrame:
    """n, strategy, distance and group for each pool size: a task each. pool and test: region, population and features.

    The matrix of regions is small (regions x features) and goes to each task with its size.
    """
    own = pool.select("region", "population", *features).withColumn("role", F.lit("pool")).unionByName(test.select("region", "population", *features).withColumn("role", F.lit("test")))
    rows = own.crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in sizes], "n int")))  # a stated list of sizes

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        p = pdf[pdf.role == "pool"].sort_values("region").reset_index(drop=True)
        t = pdf[pdf.role == "test"]
        x = pdf[features].to_numpy(float)
        mu, sd = x.mean(0), x.std(0)
        sd = np.where(sd > 0, sd, 1)
        z, zt = (p[features].to_numpy(float) - mu) / sd, ((t[features].to_numpy(float) - mu) / sd)
        tp = t["population"].to_numpy(float)
        centre = (zt * tp[:, None]).sum(0) / tp.sum()
        if n > len(p):
            return pd.DataFrame({"n": [n], "strategy": [strategy], "distance": [None], "group": [None]}).astype({"distance": float})
        search = {"hill_climb": hill_climb, "stochastic": stochastic_search}[strategy]
        group, score = search(z, p["population"].to_numpy(float), centre, np.ones(len(features)), n)
        return pd.DataFrame({"n": [n], "strategy": [strategy], "distance": [score], "group": [", ".join(sorted(p["region"].iloc[group]))]})

    return rows.groupBy("n").applyInPandas(run, "n int, strategy string, distance double, group string")
