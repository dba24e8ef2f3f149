"""Sizing of designs: a grid of shares and durations, a test group for each share, power of each candidate, and the smallest that does."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import numeric
from quadrat.operators.matching import EXHAUSTIVE, RANDOM_SUBSETS
from quadrat.operators.power import counterfactual

CANDIDATE = "share double, duration int, test_regions string, achieved_share double, rho double, power double, usable boolean, reason string"


def candidate_grid(spark: SparkSession, shares: list[float], durations: list[int]) -> DataFrame:
    """Every share with every duration: two stated lists."""
    return spark.createDataFrame([(float(s), int(d)) for s in shares for d in durations], "share double, duration int")


def test_group(sizes: dict[str, float], share: float, seed: int = 0) -> list[str]:
    """The set of regions whose size comes nearest to a share of all: of all subsets of up to 16 regions, else of 2000 random ones."""
    names, total = sorted(sizes), sum(sizes.values())
    p, n = np.array([sizes[k] for k in names]), len(sizes)
    if n <= EXHAUSTIVE:
        masks = (np.arange(1, 2**n - 1)[:, None] >> np.arange(n)) & 1
    else:
        rng = np.random.default_rng(seed)
        masks = np.argsort(np.argsort(rng.random((RANDOM_SUBSETS, n)), 1), 1) < rng.integers(1, n, RANDOM_SUBSETS)[:, None]
    off = np.abs(masks @ p / total - share)
    best = np.lexsort((np.arange(len(off)), masks.sum(1), np.round(off, 12)))[0]
    return [names[k] for k in np.flatnonzero(masks[best])]


def size_scenarios(panel: DataFrame, grid: DataFrame, effect: float, target: float = 0.8, n_sim: int = 500, alpha: float = 0.05, seed: int = 42, min_history: int = 104) -> DataFrame:
    """A row for each candidate: its test group, power of the effect over its duration, and whether it may be used. A task each."""
    rows = panel.select("region", "date", "kpi").crossJoin(F.broadcast(grid))  # a stated list of candidates

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        share, duration = float(pdf["share"].iloc[0]), int(pdf["duration"].iloc[0])
        wide = pdf.pivot(index="date", columns="region", values="kpi").dropna().sort_index()
        sizes = wide.sum().to_dict()
        tests = test_group(sizes, share)
        controls = [c for c in wide.columns if c not in tests]
        y, x = wide[tests].sum(axis=1).to_numpy(float), wide[controls].to_numpy(float)
        predict, fitted, reason = counterfactual(x, y)
        r = y - fitted
        rho, sigma = numeric.ar1(r)
        base = float(predict(x[-duration:]).sum())
        rng = [np.random.default_rng([seed, round(share * 1e6), duration, k]) for k in range(2)]
        null, alt = (base + numeric.ar1_paths(rho, sigma, duration, n_sim, g, float(r[-1])).sum(1) for g in rng)
        power = float((alt + base * effect > np.percentile(null, 100 * (1 - alpha))).mean())
        why = reason or ("short history" if len(wide) < min_history else None)
        return pd.DataFrame([(share, duration, ", ".join(tests), sum(sizes[t] for t in tests) / sum(sizes.values()), rho, power, why is None and power >= target, why)], columns=[c.split()[0] for c in CANDIDATE.split(", ")])

    return rows.groupBy("share", "duration").applyInPandas(run, CANDIDATE)


def smallest_qualifying(candidates: DataFrame, by: str = "share") -> DataFrame:
    """One row: the usable candidate of the smallest share, then duration (or the other way round)."""
    key = F.struct("share", "duration") if by == "share" else F.struct("duration", "share")
    return candidates.where("usable").agg(F.min_by(F.struct(*candidates.columns), key).alias("x")).where("x is not null").select("x.*")
