"""Runs keyed by market against single fits, and rules of the keyed operators."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.functions import numeric
from quadrat.operators import keyed
from quadrat.sources.sinks import written

START = datetime.date(2020, 1, 6)


def week(k):
    return START + datetime.timedelta(days=7 * k)


@pytest.fixture(scope="module")
def panel(spark):
    """Four regions and 70 weeks; one week of one region is missing, another has no value."""
    rng = np.random.default_rng(3)
    common = np.cumsum(rng.normal(size=70)) * 40 + 5000
    rows = []
    for j, name in enumerate("abcd"):
        own = common * (1 + j / 3) + rng.normal(size=70) * 60 * (j + 1)
        rows += [(name, week(k), None if (name, k) == ("c", 20) else float(v)) for k, v in enumerate(own) if (name, k) != ("d", 30)]
    return spark.createDataFrame(rows, "region string, date date, kpi double").repartition(3)


@pytest.fixture(scope="module")
def runs(spark, panel):
    markets = spark.createDataFrame([("a",), ("b",)], "market string")
    matched = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("b", "elsewhere")], "market string, region string")
    excluded = spark.createDataFrame([("a", "d"), ("b", "nowhere")], "market string, region string")
    return keyed.three_methods(panel, markets, matched, excluded)


def test_three_methods(runs):
    got = {}
    for x in sorted(runs.collect(), key=lambda x: x["k"]):
        got.setdefault((x["market"], x["method"]), []).append(x["region"])
    assert got == {("a", "matched"): ["b", "c"], ("a", "all"): ["b", "c", "d"], ("a", "without_excluded"): ["b", "c"], ("b", "matched"): ["d"], ("b", "all"): ["a", "c", "d"]}


def plain_design(panel, market, controls, lags):
    kpi = {(r["region"], r["date"]): r["kpi"] for r in panel.collect()}
    rows = []
    for k in range(70):
        own = [kpi.get((c, week(k - lag))) if (c, week(k)) in kpi else None for lag in (0, *lags) for c in controls]
        if kpi.get((market, week(k))) is not None and None not in own:
            rows.append((week(k), kpi[market, week(k)], own))
    return rows


@pytest.mark.parametrize("lags", [[], [1, 3]])
def test_designs(panel, runs, lags):
    got = {}
    for x in keyed.design(panel, runs, lags).collect():
        got.setdefault((x["market"], x["method"]), []).append((x["date"], x["y"], x["x"]))
    controls = {("a", "matched"): "bc", ("b", "all"): "acd"}
    for key, names in controls.items():
        assert sorted(got[key]) == plain_design(panel, key[0], names, lags)


def test_runs_equal_single_fits(spark, panel, runs):
    """Folds, placebo windows, the final fit and all that follows, from moments and from whole matrices."""
    pre_end, lags = week(55), [1]
    designs = written(keyed.design(panel, written(runs), lags))
    terms = keyed.term_labels(runs, lags)
    tasks = keyed.windows(designs, "fold", 13, 4, 20).unionByName(keyed.windows(designs, "placebo", 26, 8, 5)).unionByName(keyed.history(designs, pre_end))
    fitted = written(keyed.fits(designs, tasks))
    table = {(x["market"], x["method"], x["kind"], x["start"]): x for x in fitted.collect()}
    errors = {(x["market"], x["method"], x["kind"], x["start"]): x for x in keyed.window_errors(designs, fitted).collect()}
    result = {(x["market"], x["method"]): x for x in keyed.validation_run(designs, pre_end, terms, (13, 4), (26, 8), cut=written).collect()}
    for (market, method), names in {("a", "matched"): "bc", ("a", "without_excluded"): "bc", ("b", "all"): "acd"}.items():
        rows = plain_design(panel, market, names, lags)
        dates, y, x = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        solver = keyed.SOLVERS[method]
        for kind, first, length, most, splits in (("fold", 13, 4, 20, 3), ("placebo", 26, 8, 5, 3)):
            starts = range(first, len(y) - length + 1)
            starts = list(starts)[:: max(1, len(starts) // most)][:most]
            assert starts == sorted(k[3] for k in table if k[:3] == (market, method, kind))
            for s in starts:
                fit, own = numeric.fit_regularised(solver, x[:s], y[:s], splits), table[market, method, kind, s]
                assert own["used_cv"] == fit.used_cv
                p = fit.predict(x[s : s + length])
                assert np.allclose(own["intercept"] + x[s : s + length] @ np.array(own["coef"]), p, rtol=1e-6)
                contiguous = (dates[s + length - 1] - dates[s]).days == 7 * (length - 1)
                assert ((market, method, kind, s) in errors) == contiguous
                if contiguous:
                    want = numeric.window_errors(y[s : s + length], p)
                    assert all(errors[market, method, kind, s][c] == pytest.approx(want[c], rel=1e-5, abs=1e-6) for c in ("smape", "rmse", "bias", "bias_pct", "uplift", "uplift_pct"))
        n = sum(d <= pre_end for d in dates)
        fit = numeric.fit_regularised(solver, x[:n], y[:n], 5)
        residual = y - fit.predict(x)
        own = result[market, method]
        folds = [e for k, e in errors.items() if k[:3] == (market, method, "fold") and e["used_cv"]]
        assert own["rolling_smape"] == pytest.approx(np.mean([e["smape"] for e in folds])) and own["rolling_p90"] == pytest.approx(np.percentile([e["smape"] for e in folds], 90))
        assert own["uplift"] == pytest.approx(residual[n:].sum(), rel=1e-5)
        assert own["durbin_watson"] == pytest.approx((np.diff(residual[:n]) ** 2).sum() / (residual[:n] ** 2).sum(), rel=1e-5)
        assert (own["n_controls"], own["used_cv"], own["cv_state"], own["n_dates"]) == (len(names), True, "all", len(y))
        assert own["n_selected"] == len({names[k % len(names)] for k, c in enumerate(fit.coef) if abs(c) > 1e-6})
        assert own["row_loss"] == ("none" if 1 - len(y) / 70 <= 0.1 else "warning")


def test_short_histories(spark, panel):
    """Below six rows the penalty is stated, and the run isn't rated; a market without any row has no run."""
    runs = spark.createDataFrame([("a", "matched", "b", 1), ("x", "matched", "b", 1)], "market string, method string, region string, k int")
    designs = written(keyed.design(panel.where(F.col("date") < week(9)), runs))
    own = keyed.validation_run(designs, week(4), keyed.term_labels(runs), (5, 2), (6, 2), cut=written).collect()
    assert [(x["market"], x["used_cv"], x["cv_state"], x["confidence"]) for x in own] == [("a", False, "final", "insufficient")]


def test_moments():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=40)
    a, b = numeric.Moments.of(x, y), numeric.Moments.of(x[:25], y[:25])
    part, w = a - b, rng.normal(size=(2, 3))
    assert part.n == 15 and np.allclose(part.mean, np.r_[x[25:].mean(0), y[25:].mean()])
    assert np.allclose(part.squared_errors(np.array([1.0, 2.0]), w), [((y[25:] - k - x[25:] @ v) ** 2).sum() for k, v in zip((1.0, 2.0), w, strict=True)])
    assert np.allclose(part.centred, np.cov(np.column_stack([x, y])[25:], rowvar=False, bias=True) * 15)
    grams = np.stack([x.T @ x, x[:25].T @ x[:25]])
    got = numeric.descend_all(grams, np.stack([x.T @ y, x[:25].T @ y[:25]]), np.array([40.0, 25.0]), np.array([0.05, 0.2]), np.array([0.5, 1.0]))
    for k, (g, v, n, al, l1) in enumerate(zip(grams, [x.T @ y, x[:25].T @ y[:25]], (40, 25), (0.05, 0.2), (0.5, 1.0), strict=True)):
        assert np.allclose(got[k], numeric.descend(g, v, n, al, l1, np.zeros(3)), atol=1e-6)
