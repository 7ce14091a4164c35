"""Daily recurrence, phases, bootstrap."""
import math
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from settlegrid.functions.clock import SettlementCalendar
from settlegrid.operators import recurrence as R
from zoneinfo import ZoneInfo

LONDON = ZoneInfo("Europe/London")


def context(day, low, value=100.0):
    """Half-hours of the three local days around ``day``; ``low(local)`` is 10, else ``value``."""
    d = datetime.fromisoformat(day).replace(tzinfo=LONDON)
    a = (d - timedelta(days=1)).astimezone(timezone.utc)
    b = (d + timedelta(days=2)).astimezone(timezone.utc)
    out = []
    while a < b:
        out.append(10.0 if low(a.astimezone(LONDON)) else value)
        a += timedelta(minutes=30)
    start = (d - timedelta(days=1)).astimezone(timezone.utc).replace(tzinfo=None).isoformat()
    return out, start


def one(make_panel, day, values, start):
    return R.daily_features(make_panel({"A": values}, start), R.Season("s", day, day)).first()


def test_run_starting_at_ten_in_the_evening(make_panel):
    night = lambda t: (t.day == 15 and t.hour >= 22) or (t.day == 16 and t.hour < 5)
    v, start = context("2022-06-15", night)
    v[48:60] = [10.0] * 0 + v[48:60]
    # Enough low focal readings for a threshold between the levels.
    early = lambda t: night(t) or (t.day == 15 and 2 <= t.hour < 6)
    v, start = context("2022-06-15", early)
    r = one(make_panel, "2022-06-15", v, start)
    assert r["valid_day"] and r["longest_low_hours"] == 7.0 and r["qualifies_6h"] and not r["qualifies_8h"]


def test_gap_in_context_is_unknown_and_constant_is_known(make_panel):
    v, start = context("2022-06-15", lambda t: False)
    r = one(make_panel, "2022-06-15", v, start)
    assert r["valid_day"] and r["qualifies_6h"] is False and r["fraction_6_8h"] == 0.0
    v[3] = None
    r = one(make_panel, "2022-06-15", v, start)
    assert not r["valid_day"] and r["invalid_reason"] == "missing_context" and r["qualifies_6h"] is None


def test_run_without_an_end_is_censored(make_panel):
    v, start = context("2022-06-15", lambda t: t.day > 15 or (t.day == 15 and t.hour >= 18))
    r = one(make_panel, "2022-06-15", v, start)
    assert r["invalid_reason"] == "censored_run" and r["qualifies_6h"] is None


def test_clock_change_days_have_their_own_length(make_panel):
    for day, n in (("2022-03-27", 46), ("2022-10-30", 50)):
        v, start = context(day, lambda t: 2 <= t.hour < 6)
        r = one(make_panel, day, v, start)
        assert r["expected_periods"] == r["observed_periods"] == n and r["valid_day"]
        slots = R.profiles(make_panel({"A": v}, start)).where(f"date = '{day}'").count()
        assert slots == (46 if n == 46 else 48)


def test_neighbouring_days_do_not_leak(make_panel):
    v, start = context("2022-06-15", lambda t: 1 <= t.hour < 8)
    p = make_panel({"A": v + [1e6] * 48}, start)
    assert tuple(R.daily_features(p, R.Season("s", "2022-06-15", "2022-06-15")).first()) == tuple(one(make_panel, "2022-06-15", v, start))


def test_phase_purges_both_sides(spark):
    s = R.Season("s", "2022-06-01", "2022-06-30")
    assert s.split == "2022-06-21"
    rows = spark.sql("SELECT explode(sequence(DATE '2022-06-17', DATE '2022-06-24')) AS date")
    got = [r["p"] for r in rows.select(R.phase_of("date", s.split).alias("p")).collect()]
    assert got == ["development"] * 3 + ["boundary_purged"] * 2 + ["holdout"] * 3


def test_bootstrap_needs_four_weeks_and_brackets_the_ratio(spark):
    rows = []
    for w in range(6):
        for d in range(5):
            rows.append(("A", "s", "weekday", f"2022-06-{1 + 0:02d}", f"2022-0{5 + w // 4}-{1 + 7 * (w % 4):02d}", "development", True, (w + d) % 2 == 0, False))
    rows += [("B", "s", "weekday", "2022-06-01", "2022-05-01", "development", True, True, True)]
    daily = spark.createDataFrame(rows, "series string, season string, day_type string, date string, week string, phase string, "
                                        "valid_day boolean, qualifies_6h boolean, qualifies_8h boolean")
    got = {(r["series"], r["phase"]): r for r in R.summarize_days(daily).collect()}
    a = got[("A", "development")]
    assert a["ci_low_6h"] <= a["observed_pattern_frequency_6h"] <= a["ci_high_6h"] and a["ci_low_8h"] == a["ci_high_8h"] == 0.0
    assert got[("B", "all")]["ci_low_6h"] is None and got[("B", "all")]["evidence_status"] == "insufficient_evidence"


def test_calendar_positions_round_trip(spark):
    cal = SettlementCalendar("2022-10-29", "2022-10-31")
    f = cal.frame(spark)
    assert f.where(cal.pos_of_period("settle_date", "period") != f["pos"]).count() == 0 and math.isclose(cal.n_slots, 146)


def test_bootstrap_width_equals_independent_draws(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    for weeks in (4, 8, 26):
        blocks = [(int(rng.integers(0, 6)), 5) for _ in range(weeks)]
        df = spark.createDataFrame([(blocks,)], "b array<struct<s:long,n:long>>")
        df = df.join(R.draw_table(spark.range(weeks, weeks + 1).select(F.col("id").cast("int").alias("_w")), 1000, 7), F.lit(True))
        low, high = df.select(R.bootstrap_interval(F.col("b"), F.col("_draws"), 1000).alias("c")).select("c.*").first()
        s = np.array([x for x, _ in blocks])
        want = np.quantile(s[rng.integers(0, weeks, (4000, weeks))].sum(1) / (5 * weeks), [0.025, 0.975])
        assert abs((high - low) - (want[1] - want[0])) < 0.12 * (want[1] - want[0]) + 0.01
