"""Transfer of all regimes in one job against numpy, regime by regime."""
import numpy as np
import pandas as pd

from settlegrid.operators import recurrence as R
from settlegrid.operators.transfer import WIDTHS, eligibility, regime_transfer

KEYS = "season string, day_type string, "


def inputs(spark):
    r, rows, members = np.random.default_rng(4), [], []
    for season, day_type, n in (("summer", "weekday", 40), ("summer", "weekend", 25), ("winter", "weekday", 9)):
        base = r.normal(size=(3, 101))
        for i in range(n):
            early = r.normal(size=3) @ base + 0.1 * r.normal(size=101) + 5
            early[100] = 2.0  # a flat place
            rows += [(season, day_type, "development", f"S{i:02}", early.tolist()),
                     (season, day_type, "holdout", f"S{i:02}", (early + 0.2 * r.normal(size=101)).tolist())]
            if i:
                members.append((season, day_type, f"S{i:02}"))
    return (spark.createDataFrame(rows, KEYS + "phase string, series string, vector array<double>"),
            spark.createDataFrame(members, KEYS + "series string"))


def test_every_regime_equals_numpy(spark):
    vectors, members = inputs(spark)
    got = {(r["season"], r["day_type"], r["representation"], r["model"]): r for r in regime_transfer(vectors, members).collect()}
    assert {k[:2] for k in got} == {("summer", "weekday"), ("summer", "weekend")} and len(got) == 6
    frame = vectors.toPandas()
    out = {r["series"]: r["held_out"] for r in R.held_out(members.select("series").distinct()).collect()}
    for season, day_type in {k[:2] for k in got}:
        part = frame[(frame.season == season) & (frame.day_type == day_type) & (frame.series != "S00")]
        side = lambda phase, held: np.array(part[(part.phase == phase) & (part.series.map(out) == held)].sort_values("series")["vector"].tolist())
        train, test, later = side("development", False), side("development", True), side("holdout", True)[:, :48]
        row = got[season, day_type, "median48", "persistence"]
        assert (row["train_series"], row["test_series"]) == (len(train), len(test))
        assert np.isclose(row["later_median_rmse"], np.sqrt(((test[:, :48] - later) ** 2).mean())) and row["reconstruction_mse_scaled"] is None
        for name, width in WIDTHS.items():
            sd = train[:, :width].std(0)
            sd[sd <= 1e-12] = 1
            x, t = ((m[:, :width] - train[:, :width].mean(0)) / sd for m in (train, test))
            v = np.linalg.svd(x, full_matrices=False)[2][:2]
            guess = ((t @ v.T) @ v * sd + train[:, :width].mean(0))[:, :48]
            row = got[season, day_type, name, "pca"]
            assert np.isclose(row["later_median_rmse"], np.sqrt(((guess - later) ** 2).mean()))
            assert np.isclose(row["later_median_mae"], np.abs(guess - later).mean())
            assert np.isclose(row["reconstruction_mse_scaled"], (((x @ v.T) @ v - x) ** 2).mean())


def test_small_cohorts_are_refused(spark):
    vectors, members = inputs(spark)
    got = {(r["season"], r["day_type"]): (r["total_series"], r["eligible_series"], r["fitted"]) for r in eligibility(vectors, members).collect()}
    assert got == {("summer", "weekday"): (40, 39, True), ("summer", "weekend"): (25, 24, True), ("winter", "weekday"): (9, 8, False)}
    assert regime_transfer(vectors.where("season = 'winter'"), members).count() == 0
    assert isinstance(regime_transfer(vectors, members, minimum=8).toPandas(), pd.DataFrame)
