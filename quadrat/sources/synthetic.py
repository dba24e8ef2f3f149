"""Synthetic cases with a known truth, generated in tasks by seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "seed int, date date, region string, kpi double, counterfactual double, in_test boolean"

#: Named scenarios: what they change of the plain case.
SCENARIOS = {
    "plain": {}, "persistent": {"rho": 0.8}, "noisy": {"sigma": 12.0}, "quiet": {"sigma": 1.0}, "seasonal": {"season": 15.0}, "trend": {"trend": 0.2},
    "short_history": {"pre": 52}, "outage": {"outage": 3}, "duplicate_control": {"duplicate": True}, "constant_control": {"constant": True}, "heteroskedastic": {"spread": 2.0}, "many_controls": {"controls": 12},
}


def generate_case(seed: int, pre: int = 104, test: int = 8, controls: int = 3, rho: float = 0.3, sigma: float = 4.0, effect: float = 0.0, season: float = 0.0, trend: float = 0.0, outage: int = 0, duplicate: bool = False, constant: bool = False, spread: float = 0.0) -> pd.DataFrame:
    """Controls that walk about 100, a test region that follows them with AR(1) noise and an effect (a share) in the test weeks."""
    rng = np.random.default_rng(seed)
    n = pre + test
    t = np.arange(n)
    base = 100 + trend * t + season * np.sin(2 * np.pi * t / 52)
    x = base[:, None] + np.cumsum(rng.normal(0, 1.5, (n, controls)), 0)
    if duplicate and controls > 1:
        x[:, 1] = x[:, 0]
    if constant:
        x[:, -1] = 50.0
    weights = rng.dirichlet(np.ones(controls))
    cf = x @ weights + 20
    e = np.zeros(n)
    for k in range(1, n):
        e[k] = rho * e[k - 1] + rng.normal(0, sigma * (1 + spread * k / n))
    y = (cf + e) * np.where(t >= pre, 1 + effect, 1.0)
    if outage:
        y[5 : 5 + outage] = 0.0
    dates = pd.date_range("2022-01-02", periods=n, freq="7D").date
    frames = [pd.DataFrame({"date": dates, "region": "T", "kpi": y, "counterfactual": cf, "in_test": t >= pre})]
    frames += [pd.DataFrame({"date": dates, "region": f"C{j + 1}", "kpi": x[:, j], "counterfactual": x[:, j], "in_test": t >= pre}) for j in range(controls)]
    return pd.concat(frames, ignore_index=True).assign(seed=seed)[["seed", "date", "region", "kpi", "counterfactual", "in_test"]]


def cases(spark: SparkSession, seeds: int, **parameters) -> DataFrame:
    """One case for each seed, a task for some seeds at a time."""

    def run(frames):
        for pdf in frames:
            for s in pdf["id"]:
                yield generate_case(int(s), **parameters)

    return spark.range(seeds).mapInPandas(run, SCHEMA)
