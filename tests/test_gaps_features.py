"""Fills, quality, spectra, runs and screening."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from settlegrid.functions.clock import clock_slot, local_date
from settlegrid.operators import features as X, gaps as G


def daily_cosine(days=7):
    return [20 + 10 * math.cos(2 * math.pi * i / 48) for i in range(48 * days)]


def values(df, column="filled"):
    return {r["pos"]: (r[column], r["source"]) for r in df.collect()}


def test_short_gap_is_a_line(make_panel):
    y = daily_cosine()
    v = list(y)
    v[100:104] = [None] * 4
    got = values(G.fill_gaps(make_panel({"A": v}, "2022-06-19T23:00:00")))
    want = np.linspace(y[99], y[104], 6)[1:-1]
    assert np.allclose([got[i][0] for i in range(100, 104)], want)
    assert {got[i][1] for i in range(100, 104)} == {"linear"}


def test_longer_gap_takes_median_of_original_days(make_panel):
    y = daily_cosine()
    y[20] = 500.0
    v = list(y)
    v[96 + 17:96 + 23] = [None] * 6
    got = values(G.fill_gaps(make_panel({"A": v}, "2022-06-19T23:00:00")))
    assert math.isclose(got[96 + 20][0], daily_cosine()[20]) and got[96 + 20][1] == "seasonal_median"


def test_limits_leave_the_series_open(make_panel):
    long_gap, sparse = daily_cosine(), daily_cosine()
    long_gap[50:59] = [None] * 9
    for i in range(0, len(sparse), 4):
        sparse[i] = None
    p = G.fill_gaps(make_panel({"L": long_gap, "S": sparse, "C": [5.0] * 336}))
    q = {r["series"]: r for r in G.quality(p).collect()}
    assert q["L"]["status"] == "insufficient_evidence" and q["L"]["longest_run"] == 9 and q["L"]["imputed"] == 0
    assert q["S"]["remaining"] == 84 and not q["S"]["eligible"]
    assert q["C"]["constant"] and q["C"]["eligible"] and q["C"]["status"] == "observed"


def test_edge_gap_needs_two_donor_days(make_panel):
    for days, want in ((3, "seasonal_median"), (2, "missing")):
        v = daily_cosine(days)
        v[0] = None
        got = values(G.fill_gaps(make_panel({"A": v}, "2022-10-31T00:00:00")))
        assert got[0][1] == want


def test_repeated_autumn_slot_is_one_donor_day(make_panel):
    v = [20.0 + i % 5 for i in range(50 + 6 * 48)]  # Sunday with 50 half-hours, then Monday to Saturday
    saturday = 50 + 5 * 48
    v[saturday + 2:saturday + 4] = [None, None]
    p = make_panel({"A": v}, "2022-10-29T23:00:00")
    got = values(G.fill_gaps(p, G.FillPolicy(linear_max_gap=1)))
    assert got[saturday + 2] == (None, "missing")
    one = values(G.fill_gaps(p, G.FillPolicy(linear_max_gap=1, min_donor_days=1)))
    assert one[saturday + 2] == ((v[2] + v[4]) / 2, "seasonal_median")


def test_infinite_values_are_refused(make_panel):
    with pytest.raises(Exception, match="Infinite"):
        G.fill_gaps(make_panel({"A": [1.0, float("inf"), None, 2.0]})).collect()


def test_unbounded_line_extends_edges(make_panel):
    got = values(G.unbounded_linear(make_panel({"A": [None, 1, None, None, 4, None]})))
    assert [got[i][0] for i in range(6)] == [1, 1, 2, 3, 4, 4]


def tone(hours, n=960, scale=1.0):
    return [scale * math.sin(2 * math.pi * i / 2 / hours) for i in range(n)]


def test_pure_tones_and_scaling(make_panel):
    rows = {r["series"]: r for r in X.spectral_features(make_panel({"7": tone(7), "24": tone(24), "7x": tone(7, scale=3)})).collect()}
    assert rows["7"]["fraction_6_8h"] > 0.75 > 0.2 > rows["7"]["fraction_20_28h"]
    assert rows["24"]["fraction_20_28h"] > rows["24"]["fraction_6_8h"]
    assert math.isclose(rows["7x"]["total_power"], 9 * rows["7"]["total_power"], rel_tol=1e-9)
    assert math.isclose(rows["7x"]["fraction_6_8h"], rows["7"]["fraction_6_8h"], rel_tol=1e-9)


def test_spectrum_matches_direct_transform(make_panel):
    rng = np.random.default_rng(1)
    y = rng.normal(size=300)
    r = X.spectral_features(make_panel({"A": y})).first()
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(96) / 96)
    parts = []
    for s in range(0, 300 - 96 + 1, 48):
        seg = y[s:s + 96] - y[s:s + 96].mean()
        p = np.abs(np.fft.rfft(seg * w)) ** 2 / (2 * (w ** 2).sum())
        p[1:-1] *= 2
        parts.append(p)
    p, f = np.mean(parts, axis=0), np.arange(49) / 48
    trap = lambda a, b: ((b[1:] - b[:-1]) * (a[1:] + a[:-1]) / 2).sum()
    xs = np.r_[1 / 28, f[(f > 1 / 28) & (f < 1 / 20)], 1 / 20]
    assert math.isclose(r["total_power"], trap(p, f), rel_tol=1e-9)
    assert math.isclose(r["power_20_28h"], trap(np.interp(xs, f, p), xs), rel_tol=1e-9)


def test_too_short_for_a_spectrum(make_panel):
    with pytest.raises(Exception, match="96"):
        X.spectral_features(make_panel({"A": [1.0] * 95})).collect()


def test_run_across_midnight_and_broken_run(make_panel):
    y = [100.0] * 96
    y[40:54] = [10.0] * 14
    broken = list(y)
    broken[46] = 100.0
    got = {r["series"]: r for r in X.temporal_features(make_panel({"ok": y, "no": broken}, "2022-01-10T00:00:00")).collect()}
    assert got["ok"]["longest_observed_low_hours"] == 7.0 and got["ok"]["qualifying_start_days"] == 1
    assert got["ok"]["qualifying_day_fraction"] == 0.5
    assert got["no"]["qualifying_start_days"] == 0 and got["no"]["observed_low_runs"] == 2


def test_runs_touching_the_edges_are_censored(make_panel):
    y = [10.0] * 14 + [100.0] * 60 + [10.0] * 14 + [100.0] * 10
    r = X.temporal_features(make_panel({"A": y})).first()
    assert r["censored_low_runs"] == 2 and r["observed_low_runs"] == 0


def test_unknown_is_not_false(make_panel):
    gap = daily_cosine()
    gap[10:30] = [None] * 20
    f = G.fill_gaps(make_panel({"gap": gap, "ok": daily_cosine()}))
    got = {r["series"]: r for r in X.screen_with_quality(f, G.quality(f)).collect()}
    assert got["gap"]["candidate"] is None and got["gap"]["screening_status"] == "insufficient_evidence"
    assert got["ok"]["candidate"] is not None


def test_negative_volume_needs_review(make_panel):
    f = G.fill_gaps(make_panel({"n": [v - 25 for v in daily_cosine()]}))
    assert X.screen_with_quality(f, G.quality(f)).first()["screening_status"] == "requires_review_negative_volume"


def test_masks_have_the_announced_size(make_panel):
    m = G.mask_patterns(make_panel({"A": daily_cosine(10)}))
    size = {r["pattern"]: r["n"] for r in m.groupBy("pattern").agg(F.count_if("masked").alias("n")).collect()}
    assert size == {"random_5pct": 24, "random_20pct": 96, "block_2h": 4, "block_4h": 8, "block_6h": 12}


def test_legacy_psd_matches_fft(make_panel):
    y = np.abs(np.random.default_rng(2).normal(size=240)) + 1
    got = X.legacy_low_frequency_psd(make_panel({"A": y})).first()["int_psd"]
    p = np.abs(np.fft.fft(y / y.max())) ** 2
    p /= p.max()
    v = np.r_[p[-6:], p[:7]]
    want = (v[0] + v[-1] + 4 * v[1:-1:2].sum() + 2 * v[2:-1:2].sum()) / 240 / 3
    assert math.isclose(got, want, rel_tol=1e-9)


def test_seasonal_median_without_the_own_day_equals_brute_force(make_panel):
    """Any number of donor days, ties, and an autumn day whose other cell of the slot is known."""
    rng = np.random.default_rng(6)
    n = 48 * 30 + 2
    values = rng.integers(0, 4, n).astype(float)
    values[rng.random(n) < 0.3] = np.nan
    panel = make_panel({"A": values, "B": np.where(rng.random(n) < 0.85, np.nan, values)}, "2022-10-09T23:00:00")
    open_all = G.FillPolicy(max_missing_fraction=0.99, max_gap=n, linear_max_gap=1)
    gated = G.gate(panel, open_all).withColumn("filled", F.col("value"))  # without the line, so that every gap is open
    got = G.seasonal_fill(gated, open_all)
    rows = got.select("series", "pos", "value", "filled", "source", clock_slot("ts").alias("slot"), local_date("ts").alias("date")).collect()
    days = {}
    for r in rows:
        days.setdefault((r["series"], r["slot"], r["date"].weekday() >= 5), {}).setdefault(r["date"], []).append(r["value"])
    for r in rows:
        if r["value"] is not None:
            assert r["filled"] == r["value"]
            continue
        known = [[v for v in vs if v is not None] for d, vs in days[r["series"], r["slot"], r["date"].weekday() >= 5].items() if d != r["date"]]
        donors = [np.median(vs) for vs in known if vs]
        want = float(np.median(donors)) if len(donors) >= open_all.min_donor_days else None
        assert r["filled"] == want and r["source"] == ("missing" if want is None else "seasonal_median")
