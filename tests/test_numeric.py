"""Numeric helpers against closed forms and other algorithms."""

import numpy as np
import pytest

from quadrat.functions import numeric
from quadrat.operators import bayes, power, validation
from quadrat.sources.synthetic import SCENARIOS, generate_case


def test_penalised_fit_meets_its_optimality_conditions():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(80, 6)), rng.normal(size=80)
    x, y = x - x.mean(0), y - y.mean()
    for alpha, l1 in ((0.05, 1.0), (0.1, 0.5), (1e-4, 0.1)):
        w = numeric.descend(x.T @ x, x.T @ y, 80, alpha, l1, np.zeros(6), tol=1e-12, most=10000)
        grad = x.T @ (x @ w - y) / 80 + alpha * (1 - l1) * w
        on = w != 0
        assert np.allclose(grad[on], -alpha * l1 * np.sign(w[on]), atol=1e-8) and (np.abs(grad[~on]) <= alpha * l1 + 1e-8).all()


def test_time_splits():
    assert [(len(a), b.tolist()) for a, b in numeric.time_splits(10, 3)] == [(4, [4, 5]), (6, [6, 7]), (8, [8, 9])]


def test_short_history_uses_a_fixed_penalty():
    fit = numeric.fit_regularised("lasso", np.arange(5.0)[:, None], np.arange(5.0), 5)
    assert not fit.used_cv and (fit.alpha, fit.l1_ratio) == (1.0, 1.0)
    assert numeric.fit_regularised("enet", np.arange(30.0)[:, None], 2 * np.arange(30.0), 5).used_cv


def test_window_starts_leave_out_the_end_when_strided():
    assert validation.window_starts(52, 13, 4, 20) == list(range(13, 33))  # 36 starts, stride 1
    assert validation.window_starts(20, 13, 4, 20) == [13, 14, 15, 16]
    assert validation.window_starts(100, 13, 4, 20)[:3] == [13, 17, 21]


def test_beta_quantiles():
    assert numeric.beta_ppf(0.5, 1, 1) == pytest.approx(0.5)
    assert numeric.beta_ppf(0.9, 2, 1) == pytest.approx(0.9**0.5)
    assert numeric.clopper_pearson(0, 10)[1] == pytest.approx(1 - 0.025 ** (1 / 10))
    assert numeric.clopper_pearson(10, 10) == (pytest.approx(0.025 ** (1 / 10)), 1.0)


def test_ar1():
    rng = np.random.default_rng(1)
    path = numeric.ar1_paths(0.6, 2.0, 5000, 1, rng)[0]
    rho, sigma = numeric.ar1(path)
    assert rho == pytest.approx(0.6, abs=0.04) and sigma == pytest.approx(2.0, abs=0.1)
    sums = numeric.ar1_paths(0.5, 1.0, 40, 20000, rng)[:, -8:].sum(1)
    assert sums.var() == pytest.approx(power.analytic_variance(0.5, 1.0, 8), rel=0.05)


def test_analytic_power():
    assert power.analytic_power(0, 0.3, 1, 8) == pytest.approx(0.05)
    assert power.analytic_power(0, 0.3, 1, 8, side="two_sided") == pytest.approx(0.05)
    assert power.analytic_power(-9, 0.3, 1, 8, side="one_sided_negative") == pytest.approx(power.analytic_power(9, 0.3, 1, 8))


@pytest.mark.parametrize(("change", "reason"), [("constant", "no_informative_controls_after_sanitisation"), ("few", "underdetermined"), ("none", "no_observations"), ("combined", "rank_deficient"), ("ok", None)])
def test_fallbacks(change, reason):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 3))
    y = x.sum(1) + 5
    if change == "constant":
        x = np.ones((30, 2))
    if change == "few":
        x, y = x[:3], y[:3]
    if change == "none":
        x, y = x[:0], y[:0]
    if change == "combined":
        x[:, 2] = x[:, 0] + x[:, 1]
    predict, fitted, why = power.counterfactual(x, y)
    assert why == reason
    if reason is None:
        assert np.allclose(predict(x), y)


def test_duplicates_are_dropped_in_order():
    x = np.column_stack([np.arange(5.0), np.arange(5.0), np.ones(5), [3, 1, 4, 1, 5]])
    assert power.sanitise(x) == [0, 3]


def test_gibbs_finds_the_truth():
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(300), rng.normal(size=(300, 2))])
    e = numeric.ar1_paths(0.4, 0.5, 300, 1, rng)[0]
    draws = bayes.gibbs(x, x @ [0.3, 1.0, -0.5] + e, np.full(3, 2.0), 800, 400, rng)
    assert np.allclose(draws.mean(0), [0.3, 1.0, -0.5, 0.5, 0.4], atol=0.15)


def test_cases_are_reproducible():
    for p in SCENARIOS.values():
        a, b = generate_case(5, **p), generate_case(5, **p)
        assert a.equals(b) and a["kpi"].notna().all()


def test_fits_of_many_problems_are_optimal():
    """Against long single descents: fewer rows than terms, repeated and empty columns, columns that move together."""
    rng = np.random.default_rng(5)
    for t in range(24):
        n, p = int(rng.integers(6, 60)), int(rng.integers(1, 8))
        x = rng.normal(size=(n, 1)) * 4 * (t % 2) + rng.normal(size=(n, p))
        if t % 4 == 0:
            x[:, -1] = x[:, 0]
        if t % 5 == 0:
            x[:, 0] = 0
        y = x @ rng.normal(size=p) + rng.normal(size=n)
        x, y = x - x.mean(0), y - y.mean()
        alpha, l1 = 10.0 ** rng.uniform(-3, 1, 8), rng.choice([0.1, 0.5, 1.0], 8)
        got = numeric.descend_all(np.repeat((x.T @ x)[None], 8, 0), np.repeat((x.T @ y)[None], 8, 0), np.full(8, float(n)), alpha, l1)
        for own, a, r in zip(got, alpha, l1, strict=True):
            loss = lambda w: ((y - x @ w) ** 2).sum() / (2 * n) + a * r * np.abs(w).sum() + a * (1 - r) / 2 * w @ w  # noqa: B023, E731
            assert loss(own) <= loss(numeric.descend(x.T @ x, x.T @ y, n, a, r, np.zeros(p), tol=1e-10, most=5000)) + 1e-9
