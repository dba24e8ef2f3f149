"""What draws of a posterior say: convergence, effective sizes, intervals by period, and the priors that went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators import bayes

#: Fixed limits of the checks.
R_HAT_LIMIT, ESS_LIMIT, MCSE_LIMIT = 1.01, 500, 0.10
WEAK_SIGMA = 0.5


def chains_of(draws: DataFrame, split: bool = True) -> DataFrame:
    """parameter, chain, i, value: chains of equal length, from parameter, chain, draw, value. With ``split`` halves of chains are chains.

    The shortest chain's length counts for all of a parameter; of an odd length the middle draw is left out by the split.
    """
    own = draws.where("value is not null").withColumn("i", F.row_number().over(Window.partitionBy("parameter", "chain").orderBy("draw")) - 1)
    length = own.groupBy("parameter", "chain").agg(F.count("*").alias("n")).groupBy("parameter").agg(F.min("n").cast("int").alias("n"))
    own = own.join(length, "parameter").where("i < n")
    if not split:
        return own.select("parameter", F.col("chain").cast("string").alias("chain"), "i", "value")
    half = F.floor(F.col("n") / 2).cast("int")
    late = F.col("i") >= F.col("n") - half
    own = own.where(late | (F.col("i") < half))
    return own.select("parameter", F.concat(F.col("chain").cast("string"), F.when(late, ".2").otherwise(".1")).alias("chain"), F.when(late, F.col("i") - F.col("n") + half).otherwise(F.col("i")).alias("i"), "value")


def autocovariances(chains: DataFrame) -> DataFrame:
    """parameter, lag, acov: by lag, averaged over chains: sums over a chain's pairs of that lag over the chain's length."""
    w = Window.partitionBy("parameter", "chain")
    own = chains.withColumn("c", F.col("value") - F.avg("value").over(w)).withColumn("n", F.count("*").over(w))
    first, later = own.select("parameter", "chain", "i", "c", "n"), own.select("parameter", "chain", F.col("i").alias("j"), F.col("c").alias("d"))
    pairs = first.join(later, ["parameter", "chain"]).where("j >= i")  # within a chain only
    each = pairs.groupBy("parameter", "chain", (F.col("j") - F.col("i")).alias("lag")).agg((F.sum(F.col("c") * F.col("d")) / F.max("n")).alias("acov"))
    return each.groupBy("parameter", "lag").agg(F.avg("acov").alias("acov"))


def convergence(draws: DataFrame, split: bool = True) -> DataFrame:
    """A row for each parameter: n_chains, n_draws (a chain's), sd, r_hat, ess, mcse, mcse_ratio and whether each check holds.

    Effective sizes take autocorrelations in pairs of neighbouring lags, as long as their sum is positive, and never rising.
    """
    chains = chains_of(draws, split)
    each = chains.groupBy("parameter", "chain").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    over = each.groupBy("parameter").agg(F.count("*").alias("n_chains"), F.max("n").alias("n_draws"), F.avg("v").alias("within"), F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("between"))
    over = over.withColumn("plus", F.col("within") * (F.col("n_draws") - 1) / F.col("n_draws") + F.col("between"))
    rho = autocovariances(chains).join(over, "parameter").select("parameter", "lag", F.when(F.col("lag") == 0, 1.0).otherwise(1 - (F.col("within") - F.col("acov")) / F.col("plus")).alias("rho"))
    pairs = rho.groupBy("parameter", F.floor(F.col("lag") / 2).alias("k")).agg(F.sum("rho").alias("p"), F.count("*").alias("whole")).where("whole = 2")
    order = Window.partitionBy("parameter").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumn("least", F.min("p").over(order)).where("least >= 0")
    tau = pairs.groupBy("parameter").agg((2 * F.sum("least") - 1).alias("tau"))
    total = F.col("n_chains") * F.col("n_draws")
    sd = chains.groupBy("parameter").agg(F.stddev_samp("value").alias("sd"))
    x = over.join(sd, "parameter").join(tau, "parameter", "left").withColumn("ess", total / F.greatest(F.coalesce("tau", F.lit(1.0)), 1 / F.log10(total)))
    x = x.withColumn("r_hat", F.sqrt(F.col("plus") / F.col("within"))).withColumn("mcse", F.col("sd") / F.sqrt("ess")).withColumn("mcse_ratio", F.col("mcse") / F.col("sd"))
    return x.select("parameter", "n_chains", "n_draws", "sd", "r_hat", "ess", "mcse", "mcse_ratio", (F.col("r_hat") <= R_HAT_LIMIT).alias("r_hat_ok"), (F.col("ess") >= ESS_LIMIT).alias("ess_ok"), (F.col("mcse_ratio") < MCSE_LIMIT).alias("mcse_ok"))


def convergence_summary(checks: DataFrame, n_divergences: int | None = None) -> DataFrame:
    """One row: the worst of each figure over all parameters, and whether all checks hold. A single divergence fails."""
    x = checks.agg(F.max("r_hat").alias("max_r_hat"), F.min("ess").alias("min_ess"), F.max("mcse_ratio").alias("max_mcse_ratio"), F.bool_and(F.col("r_hat_ok") & F.col("ess_ok") & F.col("mcse_ok")).alias("ok"))
    return x.withColumn("ok", F.coalesce("ok", F.lit(False)) & F.lit(not n_divergences)).withColumn("n_divergences", F.lit(n_divergences).cast("int"))


def period_intervals(draws: DataFrame, periods: DataFrame, low: float = 0.03, high: float = 0.97) -> DataFrame:
    """date, actual, fitted, lower, upper, p_positive: each period's fitted values over all draws.

    draws: intercept, coef (an array); periods: date, x (an array in the same order), actual. A draw gives a value for each period;
    the percentiles are exact, from counts of values that are combined before the shuffle. Periods are a few hundred dates.
    """
    value = F.col("intercept") + F.aggregate(F.zip_with("coef", "x", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    rows = draws.select("intercept", "coef").join(F.broadcast(periods.select("date", "x", "actual")), how="cross").select("date", "actual", value.alias("v"))
    q = F.percentile("v", F.array(F.lit(low), F.lit(high)))
    out = rows.groupBy("date", "actual").agg(F.avg("v").alias("fitted"), q.alias("q"), F.avg(F.when(F.col("actual") > F.col("v"), 1.0).otherwise(0.0)).alias("p_positive"))
    return out.select("date", "actual", "fitted", F.get("q", 0).alias("lower"), F.get("q", 1).alias("upper"), "p_positive")


def total_intervals(draws: DataFrame, low: float = 0.03, high: float = 0.97) -> DataFrame:
    """One row: the uplift (actual less predicted, by draw) with its interval, its percentage of the mean prediction, and how likely it is positive."""
    q = F.percentile("uplift", F.array(F.lit(low), F.lit(high)))
    x = draws.agg(F.avg("uplift").alias("mean_uplift"), q.alias("q"), F.avg(F.when(F.col("uplift") > 0, 1.0).otherwise(0.0)).alias("p_positive"), (F.try_divide(F.avg("uplift"), F.avg("base")) * 100).alias("uplift_pct"))
    return x.select("mean_uplift", F.get("q", 0).alias("lower"), F.get("q", 1).alias("upper"), "p_positive", "uplift_pct")


def structural_sigmas(distances: DataFrame, bounds: DataFrame) -> DataFrame:
    """market, region, distance, similarity, sigma: similarities 1 / (1 + distance), stretched by market to [sigma_min, sigma_max]; all alike get the high end."""
    x = distances.withColumn("similarity", 1 / (1 + F.col("distance"))).join(bounds, "market")
    w = Window.partitionBy("market")
    lo, hi = F.min("similarity").over(w), F.max("similarity").over(w)
    s = F.when(hi > lo, F.col("sigma_min") + (F.col("sigma_max") - F.col("sigma_min")) * (F.col("similarity") - lo) / (hi - lo)).otherwise(F.col("sigma_max"))
    return x.select("market", "region", "distance", "similarity", s.alias("sigma"))


def correlation_bounds(panel: DataFrame, controls: DataFrame, low: float = 0.05, high: float = 2.0) -> DataFrame:
    """market, sigma_min, sigma_max: ``bayes.correlation_bounds`` by market. controls: market, region."""
    own = panel.select(F.col("region").alias("market"), "date", F.col("kpi").alias("y"))
    c = controls.select("market", "region").join(panel, "region").join(own, ["market", "date"]).groupBy("market", "region").agg(F.abs(F.corr("kpi", "y")).alias("r"))
    m = c.groupBy("market").agg(F.median("r").alias("m"))
    return m.select("market", F.greatest(F.lit(low), F.col("m") / 4).alias("sigma_min"), F.least(F.lit(high), F.col("m") * 1.25).alias("sigma_max"))


def prior_table(terms: DataFrame, sigmas: DataFrame | None = None) -> DataFrame:
    """market, feature, region, term, distance, similarity, sigma, kind for every term of a run's controls, lagged ones with their control's sigma.

    terms: market, terms (``keyed.term_labels``); without sigmas, or for a control that has none, the weak prior.
    """
    rows = terms.select("market", F.explode("terms").alias("t")).select("market", "t.feature", "t.region", "t.term").distinct()
    nothing = F.lit(None).cast("double")
    if sigmas is None:
        return rows.select("*", nothing.alias("distance"), nothing.alias("similarity"), F.lit(WEAK_SIGMA).alias("sigma"), F.lit("weak").alias("kind"))
    x = rows.join(sigmas, ["market", "region"], "left")
    return x.select("market", "feature", "region", "term", "distance", "similarity", F.coalesce("sigma", F.lit(WEAK_SIGMA)).alias("sigma"), F.when(F.col("sigma").isNull(), "weak").otherwise("structural").alias("kind"))


def divergences(draws: DataFrame) -> DataFrame:
    """One row: draws, and divergent ones: none by nature, as the sampler takes no gradient steps."""
    return draws.agg(F.count("*").alias("n_draws"), F.lit(0).cast("long").alias("n_divergences"), F.lit(bayes.gibbs.__name__).alias("sampler"))
