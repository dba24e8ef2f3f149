"""Evidence on the methods themselves: many synthetic cases, each analysed in a task, and their summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import numeric
from quadrat.operators.power import analytic_power, counterfactual
from quadrat.sources.synthetic import SCENARIOS, generate_case

RUN = "scenario string, seed int, method string, fit string, rho double, power double, reference double, null_rate double, fallback string"


def run_evidence(spark: SparkSession, scenarios: list[str], seeds: int, methods: tuple[str, ...] = ("model_simulation", "residual_simulation"), fit: str = "ols", n_sim: int = 500, effect: float = 0.03, alpha: float = 0.05) -> DataFrame:
    """A row for each scenario, seed and method: simulated power of an effect, the analytic one of the true process, and the rate of false alarms."""
    tasks = spark.createDataFrame([(s, k) for s in scenarios for k in range(seeds)], "scenario string, seed int").repartition(max(1, min(len(scenarios) * seeds, 4 * spark.sparkContext.defaultParallelism)))

    def run(frames):
        for pdf in frames:
            for s, seed in zip(pdf["scenario"], pdf["seed"], strict=True):
                p = {"rho": 0.3, "sigma": 4.0, "test": 8} | SCENARIOS[s]
                case = generate_case(int(seed), **SCENARIOS[s])
                wide = case.pivot(index="date", columns="region", values="kpi")
                pre = ~case[case.region == "T"].set_index("date")["in_test"].reindex(wide.index).to_numpy()
                x, y = wide.drop(columns="T").to_numpy(float), wide["T"].to_numpy(float)
                predict, fitted, reason = counterfactual(x[pre], y[pre], fit)
                r, base, n = y[pre] - fitted, float(predict(x[~pre]).sum()), int((~pre).sum())
                rho, sigma = numeric.ar1(r)
                out = []
                for m in methods:
                    rng = [np.random.default_rng([int(seed), k]) for k in range(2)]
                    draw = (lambda g: numeric.ar1_paths(rho, sigma, n, n_sim, g, float(r[-1])).sum(1)) if m == "model_simulation" else (lambda g: numeric.block_bootstrap_sums(r, n_sim, n, g))  # noqa: B023
                    null, alt = draw(rng[0]), draw(rng[1])
                    c = np.percentile(null, 100 * (1 - alpha))
                    out.append((s, int(seed), m, fit, rho, float((alt + base * effect > c).mean()), analytic_power(base * effect, p["rho"], p["sigma"], n, alpha), float((alt > c).mean()), reason))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in RUN.split(", ")])

    return tasks.mapInPandas(run, RUN)


def summarise(runs: DataFrame) -> DataFrame:
    """Grouping sets: by scenario, method and fit; by scenario; and over all. A spread of one run is 0."""
    keys = ["scenario", "method", "fit"]
    spread = F.coalesce(F.stddev_samp("power"), F.lit(0.0)).alias("power_sd")
    return runs.groupingSets([keys, ["scenario"], []], *keys).agg(
        F.grouping_id(*keys).alias("level"), F.count("*").alias("n_runs"), F.avg("power").alias("power_mean"), spread,
        F.avg(F.col("power") - F.col("reference")).alias("bias"), F.avg("null_rate").alias("null_rate"), F.count("fallback").alias("n_fallback"),
    )


def seed_sensitivity(runs: DataFrame) -> DataFrame:
    """By scenario and method: the spread of power over seeds, and quantiles of its bias."""
    q = F.percentile(F.col("power") - F.col("reference"), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return runs.groupBy("scenario", "method").agg(F.stddev_samp("power").alias("power_sd"), q.alias("q")).select("scenario", "method", "power_sd", F.get("q", 0).alias("bias_p5"), F.get("q", 1).alias("bias_p50"), F.get("q", 2).alias("bias_p95"))


def _finite(c: Column) -> Column:
    return F.when(F.abs(c) < float("inf"), c)  # NaN is above it


def _spread(c: Column, name: str, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> list[Column]:
    q = F.percentile(_finite(c), F.array(*map(F.lit, shares)))
    return [*(F.get(q, k).alias(f"{name}_p{round(100 * s)}") for k, s in enumerate(shares)), F.avg(_finite(c)).alias(f"{name}_mean"), F.count(_finite(c)).alias(f"{name}_n")]


def method_rates(runs: DataFrame, expected: DataFrame, alpha: float = 0.05) -> DataFrame:
    """How far runs keep to what their scenarios call for: a row for each scenario, method and fit (level 0), and one over all (level 7).

    runs: scenario, method, fit, completed, n_blockers, error, fallback, power_zero, power, reference, mde, reference_mde,
    mde_reached, reference_reached, seconds. expected: scenario, blocked (whether its runs ought to be); other scenarios count
    in neither rate. Falsely supported: completed though to be blocked. Falsely blocked: neither completed nor failed though to
    be supported. False effect: of completed runs with a known reference, one is reported that the reference doesn't reach.
    Biases are those of completed runs; a null completed is false, an empty error or fallback none; rates of no run are null; no runs give no rows.
    power_sd spreads the deviation of power over the runs of each scenario, method and fit that has two. Percentiles are
    exact; a group's distinct values are held while they are counted.
    """
    keys = ["scenario", "method", "fit"]
    done, told = F.coalesce("completed", F.lit(False)), lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    own = runs.join(expected.select("scenario", F.col("blocked").alias("to_block")), "scenario", "left").withColumn("completed", done).withColumn("failed", told("error")).withColumn("fell_back", told("fallback"))
    ok, reached, known = F.col("completed"), F.coalesce("mde_reached", F.lit(False)), F.col("reference_reached")
    both = ok & reached & known & (F.col("reference_mde") != 0)
    bias = F.when(ok, F.col("power") - F.col("reference"))
    eligible = ok & known.isNotNull()
    blocked_wrong, supported_wrong = ~F.col("to_block") & ~ok & ~F.col("failed"), F.col("to_block") & ok
    out = own.groupingSets([keys, []], *keys).agg(
        F.grouping_id(*keys).alias("level"), F.count("*").alias("n_runs"), F.count_if(ok).alias("n_completed"), F.count_if("failed").alias("n_failed"), (F.count("*") - F.count_if(ok) - F.count_if("failed")).alias("n_incomplete"),
        F.count_if(F.col("n_blockers") > 0).alias("n_blocked"), F.count_if("fell_back").alias("n_fallback"),
        *_spread(F.when(ok, F.abs(F.col("power_zero") - alpha)), "null_error"), *_spread(bias, "power_bias"), *_spread(F.abs(bias), "power_error"), F.max(F.abs(bias)).alias("power_error_worst"),
        *_spread(F.when(both, F.abs(F.col("mde") - F.col("reference_mde")) / F.abs("reference_mde")), "mde_error"),
        F.count_if(supported_wrong).alias("n_false_supported"), F.try_divide(F.count_if(supported_wrong), F.count_if("to_block")).alias("false_supported_rate"),
        F.count_if(blocked_wrong).alias("n_false_blocked"), F.try_divide(F.count_if(blocked_wrong), F.count_if(~F.col("to_block"))).alias("false_blocked_rate"),
        F.count_if(eligible & reached & ~known).alias("n_false_mde"), F.try_divide(F.count_if(eligible & reached & ~known), F.count_if(eligible)).alias("false_mde_rate"), *_spread(F.col("seconds"), "seconds", (0.5, 0.95)),
    )
    per = own.where(ok & F.col("power").isNotNull()).groupBy(*keys).agg(F.stddev_samp("power").alias("sd"), F.count("*").alias("n")).where("n > 1")
    sds = per.groupingSets([keys, []], *keys).agg(F.grouping_id(*keys).alias("level"), *_spread(F.col("sd"), "power_sd"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["level", *keys]]
    return out.alias("a").join(sds.alias("b"), same, "left").select("a.*", *(f"b.{c}" for c in sds.columns if c.startswith("power_sd")))
