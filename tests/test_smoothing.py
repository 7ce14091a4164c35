"""The filter through gaps against dense Gaussian conditionals; fitted smoothing against its grid and random search."""
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from settlegrid.operators import association as A, forecast as W, models as M
from settlegrid.operators.smoothing import filter_through_gaps, fit_smoothing, parameters, smooth

COEF = (0.5, 0.4, -0.2)


def dense_conditional(values, origin, horizon, coef, noise, prior, first=0):
    """Mean of the next values given the known ones before the origin, from the joint covariance of all of them."""
    total = 49 + origin - first + horizon
    load = np.eye(total)
    for t in range(49, total):
        load[t] += coef[0] * load[t - 1] + coef[1] * load[t - 48] + coef[2] * load[t - 49]
    cover = (load * np.where(np.arange(total) < 49, prior, noise)) @ load.T
    seen = [49 + i for i, v in enumerate(values[first:origin]) if np.isfinite(v)]
    ahead = range(49 + origin - first, total)
    return cover[np.ix_(ahead, seen)] @ np.linalg.solve(cover[np.ix_(seen, seen)], values[first:origin][[i - 49 for i in seen]])


@pytest.mark.parametrize("gaps", [[149], [100, 101, 102, 149], [10, 30, 60, 90, 120, 147, 148, 149], range(40, 150, 13), range(0, 150, 2), []])
def test_filter_equals_the_dense_conditional(gaps):
    y = np.random.default_rng(1).normal(size=150) * 2
    y[list(gaps)] = np.nan
    origins = [60, 101, 130, 150]
    got = filter_through_gaps(y, origins, [COEF] * 4, [0.3] * 4, [4.0] * 4, 48)
    for row, o in zip(got, origins):
        assert np.allclose(row, dense_conditional(y, o, 48, COEF, 0.3, 4.0), atol=1e-10)


def test_filter_knows_nothing_before_its_window():
    y = np.random.default_rng(2).normal(size=150)
    y[::7] = np.nan
    got = filter_through_gaps(y, [120, 150], [COEF] * 2, [0.3] * 2, [4.0] * 2, 10, first=[20, 50])
    # The 49 values before the window are unknown numbers of the prior's kind, as in the dense form.
    assert np.allclose(got[0], dense_conditional(y, 120, 10, COEF, 0.3, 4.0, 20), atol=1e-10)
    assert np.allclose(got[1], dense_conditional(y, 150, 10, COEF, 0.3, 4.0, 50), atol=1e-10)


def noisy(n=480, seed=3):
    r, t = np.random.default_rng(seed), np.arange(n)
    return 20 + 5 * np.sin(2 * np.pi * t / 48) + r.normal(size=n)


def test_forecasts_through_gaps(make_panel):
    y = noisy()
    last, donor = y.copy(), y.copy()
    last[399], donor[[360, 361]] = np.nan, np.nan
    panel = make_panel({"FULL": y, "LAST": last, "DONOR": donor, "LATE": np.r_[y[:400], [np.nan] * 80]})
    got = {}
    for r in M.seasonal_ar(panel, range(400, 401), 48).collect():
        got.setdefault(r["series"], {})[r["lead"]] = r["prediction"]
        assert r["reason"] == "" and r["prediction"] is not None
    assert got["FULL"] == got["LATE"]  # nothing after the origin matters
    for name, values in (("LAST", last), ("DONOR", donor)):
        rows = np.arange(49, 400)
        x = np.c_[values[rows - 1], values[rows - 48], values[rows - 49], values[rows]]
        x = x[np.isfinite(x).all(1)]
        coef, rss, *_ = np.linalg.lstsq(x[:, :3], x[:, 3], rcond=None)
        want = dense_conditional(values, 400, 48, coef, rss[0] / len(x), np.nanmean(values[:400] ** 2))
        assert np.allclose([got[name][k] for k in range(1, 49)], want, rtol=1e-6)
    trailing = M.seasonal_ar(panel.where("series = 'LAST'"), range(400, 401), 8, train_window=380).collect()
    assert all(r["prediction"] is not None for r in trailing)


@pytest.mark.parametrize("trend, damped", [(False, False), (True, False), (True, True)])
def test_fit_is_no_worse_than_grid_and_random_search(trend, damped):
    y = noisy() + np.random.default_rng(4).normal(size=480).cumsum() * 0.3
    u, phi, error, converged, states, grid = fit_smoothing(y / 30, 48, [400, 480], trend, damped)
    assert converged.all() and (error <= grid).all()
    random = np.random.default_rng(5).random((400, 4))
    alpha, beta, gamma, p = parameters(random, damped)
    p = p if damped else np.ones(400) if trend else None
    for stop, e in zip((400, 480), error):
        assert e <= smooth(y / 30, 48, alpha, beta if trend else beta * 0, gamma, p, np.full(400, stop))[0].min() * (1 + 1e-9)


def test_slopes_equal_differences():
    y, u = noisy(200) / 30, np.array([[0.3, 0.4, 0.5, 0.6]])
    slopes = np.zeros((1, 4, 4))
    slopes[0] = np.eye(4)
    stops = np.array([200])
    start = [0.3, 0.1, 0.2, 0.9]
    run = lambda p: smooth(y, 48, *[np.array([v]) for v in p], stops)[0][0]
    _, _, first, _ = smooth(y, 48, *[np.array([v]) for v in start], stops, slopes)
    for i in range(4):
        up, down = list(start), list(start)
        up[i], down[i] = up[i] + 1e-5, down[i] - 1e-5
        assert np.isclose(2 * first[0, i], (run(up) - run(down)) / 2e-5, rtol=1e-5)


def test_a_fit_that_does_not_converge_gives_no_forecast(make_panel):
    panel = make_panel({"A": noisy()})
    cut = M.ets(panel, range(400, 449, 48), 8, max_rounds=1).collect()
    assert {(r["reason"], r["prediction"]) for r in cut} == {("nonconvergence", None)}
    whole = M.ets(panel, range(400, 449, 48), 8).collect()
    assert {r["reason"] for r in whole} == {""} and all(r["prediction"] is not None for r in whole)
    trailing = M.ets(panel, range(400, 449, 48), 8, trend=True, damped=True, train_window=360).collect()
    assert {r["reason"] for r in trailing} == {""}


def test_permutation_goes_through_the_fitted_models(make_panel, spark):
    t = np.arange(700)
    warm = 10 + 5 * np.sin(2 * np.pi * t / 48) + np.random.default_rng(7).normal(size=700)
    panel = make_panel({"A": 20 - warm + np.random.default_rng(8).normal(size=700) * 0.1, "B": 3 * warm})
    covariate = panel.select("series", "ts", "pos").join(
        spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(warm)], "pos int, temperature_c double"), "pos").drop("pos")
    plan = W.WalkForward(432, 650, 700, step=96, horizons=(8,))
    small = M.PooledTree(horizon=8, min_history=96, training_step=24, iterations=4, depth=3, min_training_rows=50, spec=W.FeatureSpec((1, 48), (), (), 1, (48,)))
    models, rows = M.fit_origins(panel, plan, small, covariate=covariate)
    assert len(models) == len(plan.positions()) > 1 and all(m.pipeline is not None for m in models.values())
    folds = spark.createDataFrame([(o, datetime(2022, 6, 1)) for o in models], "origin_pos int, origin timestamp")
    donors = A.season_derangement(folds, 2, seed=5)
    detail = lambda: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in A.permutation_detail(
        rows, donors, lambda df: M.predict_origins(models, df), (8,)).collect())
    found = detail()
    assert found == detail() and len(found) == 2 * 2 * len(models)  # series, repeats, origins
    cases, _ = M.pooled_backtest(panel, plan, small, covariate=covariate)
    error = {(r["series"], r["origin_pos"]): r["e"] for r in cases.groupBy("series", "origin_pos").agg(
        F.sum(F.abs(F.col("prediction") - F.col("actual"))).alias("e")).collect()}
    for series, origin, _, _, n, original, *_ in found:
        assert n == 8 and np.isclose(original, error[series, origin])
    assert sum(r[6] for r in found) > sum(r[5] for r in found)  # lent temperatures tell less
