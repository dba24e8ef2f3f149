"""Bayesian regression on time series: prior scales, a Gibbs sampler by chain, posterior summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prior_sigmas(distances: DataFrame, low: float = 0.1, high: float = 1.0) -> DataFrame:
    """region and sigma: similarity 1 / (1 + distance), stretched to [low, high]; all alike get the high end."""
    x = distances.withColumn("similarity", 1 / (1 + F.col("distance")))
    e = x.agg(F.min("similarity").alias("lo"), F.max("similarity").alias("hi"))
    s = F.when(F.col("hi") > F.col("lo"), low + (high - low) * (F.col("similarity") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(high)
    return x.join(F.broadcast(e)).select("region", "distance", "similarity", s.alias("sigma"))  # one row


def correlation_bounds(panel: DataFrame, series: DataFrame, low: float = 0.05, high: float = 2.0) -> DataFrame:
    """One row: the median absolute correlation of controls with the test series, and bounds of prior scales around it."""
    c = panel.join(series, "date").groupBy("region").agg(F.abs(F.corr("kpi", "test_kpi")).alias("r"))
    m = c.agg(F.median("r").alias("median_abs_correlation"))
    return m.select("median_abs_correlation", F.greatest(F.lit(low), F.col("median_abs_correlation") / 4).alias("sigma_min"), F.least(F.lit(high), F.col("median_abs_correlation") * 1.25).alias("sigma_max"))


def gibbs(x: np.ndarray, y: np.ndarray, prior_sd: np.ndarray, draws: int, tune: int, rng: np.random.Generator, sigma_scale: float = 1.0):
    """Draws of (coefficients, sigma, rho) of y = x b + e, e an AR(1) process, N(0, prior_sd) coefficients, half-normal sigma, flat rho."""
    n, k = x.shape
    b, s, rho = np.zeros(k), 1.0, 0.0
    out = np.empty((draws, k + 2))

    def log_post(s, rho, e):
        u = e[1:] - rho * e[:-1]
        ss = (1 - rho**2) * e[0] ** 2 + (u**2).sum()
        return -n * np.log(s) + 0.5 * np.log(1 - rho**2) - ss / (2 * s * s) - s * s / (2 * sigma_scale**2)

    for i in range(tune + draws):
        q = np.sqrt(1 - rho**2)
        z = np.vstack([q * x[:1], x[1:] - rho * x[:-1]])
        v = np.r_[q * y[:1], y[1:] - rho * y[:-1]]
        precision = z.T @ z / s**2 + np.diag(1 / prior_sd**2)
        chol = np.linalg.cholesky(precision)
        mean = np.linalg.solve(precision, z.T @ v / s**2)
        b = mean + np.linalg.solve(chol.T, rng.normal(size=k))
        e = y - x @ b
        now = log_post(s, rho, e)
        for _ in range(2):
            s2 = s * np.exp(0.15 * rng.normal())
            new = log_post(s2, rho, e)
            if np.log(rng.random()) < new - now + np.log(s2 / s):
                s, now = s2, new
            r2 = rho + 0.12 * rng.normal()
            if abs(r2) < 0.999:
                new = log_post(s, r2, e)
                if np.log(rng.random()) < new - now:
                    rho, now = r2, new
        if i >= tune:
            out[i - tune] = [*b, s, rho]
    return out


def sample_posterior(matrix: DataFrame, terms: list[str], pre_end, prior: dict[str, float], chains: int = 4, draws: int = 500, tune: int = 300, seed: int = 42) -> DataFrame:
    """chain, draw, uplift (of the dates after ``pre_end``, with AR(1) noise), intercept, coef, sigma, rho: a task a chain."""
    rows = matrix.crossJoin(matrix.sparkSession.range(chains).select(F.col("id").cast("int").alias("chain")))  # a stated number of chains

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        chain = int(pdf["chain"].iloc[0])
        pre = (pd.to_datetime(pdf["date"]) <= pd.Timestamp(pre_end)).to_numpy()
        x, y = pdf[terms].to_numpy(float), pdf["test_kpi"].to_numpy(float)
        mx, sx = x[pre].mean(0), x[pre].std(0)
        sx = np.where(sx > 0, sx, 1.0)
        my, sy = y[pre].mean(), y[pre].std() or 1.0
        z, v = np.column_stack([np.ones(len(y)), (x - mx) / sx]), (y - my) / sy
        rng = np.random.default_rng([seed, chain])
        d = gibbs(z[pre], v[pre], np.r_[1.0, [prior[t] for t in terms]], draws, tune, rng)
        k = len(terms) + 1
        last = v[pre][-1] - d[:, :k] @ z[pre][-1]
        noise, e = np.zeros(draws), last
        for _ in range(int((~pre).sum())):
            e = d[:, k + 1] * e + rng.normal(0, d[:, k])
            noise += e
        predicted = ((z[~pre] @ d[:, :k].T).sum(0) + noise) * sy + my * int((~pre).sum())
        return pd.DataFrame({"chain": chain, "draw": np.arange(draws), "uplift": y[~pre].sum() - predicted, "base": predicted, "intercept": d[:, 0], "coef": list(d[:, 1:k]), "sigma": d[:, k], "rho": d[:, k + 1]})

    return rows.groupBy("chain").applyInPandas(run, "chain int, draw int, uplift double, base double, intercept double, coef array<double>, sigma double, rho double")


def posterior_summary(draws: DataFrame) -> DataFrame:
    """One row: mean uplift, its 3 to 97 percent interval, percent of the base, and the share of draws above nothing."""
    q = F.percentile("uplift", F.array(F.lit(0.03), F.lit(0.97)))
    return draws.agg(F.avg("uplift").alias("mean_uplift"), q.alias("q"), (F.avg(F.col("uplift") / F.col("base")) * 100).alias("mean_pct"), F.avg(F.when(F.col("uplift") > 0, 1.0).otherwise(0.0)).alias("p_positive"), F.count("*").alias("n_draws")).select("mean_uplift", F.get("q", 0).alias("lower"), F.get("q", 1).alias("upper"), "mean_pct", "p_positive", "n_draws")


def r_hat(draws: DataFrame, column: str) -> DataFrame:
    """One row: the split-free potential scale reduction of a column over chains, and whether it is at most 1.01."""
    c = draws.groupBy("chain").agg(F.avg(column).alias("m"), F.var_samp(column).alias("v"), F.count("*").alias("n"))
    w = c.agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.max("n").alias("n"))
    r = F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w"))
    return w.select(F.lit(column).alias("parameter"), r.alias("r_hat"), (r <= 1.01).alias("converged"))
