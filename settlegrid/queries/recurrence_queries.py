"""Seasonal recurrence queries (gaps read as 0 here, because a full context is needed)."""
from pyspark.sql import functions as F

from ..operators import recurrence as R, transfer as T
from ..session import durable
from .inputs import ZPANEL, panel, registrar, sql, zero_panel

Q, SQL, query = registrar()
SEASON = R.Season("winter", "2024-01-02", "2024-01-29")
RULE = R.RecurrenceRule(min_coverage=0.1, min_valid_days=2)


def _periodogram(key="k"):
    return f"""
fx AS (SELECT {key}, pos - min(pos) OVER (PARTITION BY {key}) AS n, value - avg(value) OVER (PARTITION BY {key}) AS x FROM ctx WHERE focal),
tw AS (SELECT CAST(k AS INTEGER) AS b, CAST(n AS INTEGER) AS n, cos(2*pi()*k*n/48) AS c, sin(2*pi()*k*n/48) AS s, 0.5-0.5*cos(2*pi()*n/48) AS w
 FROM range(0,25) a(k), range(0,48) c(n)),
dens AS (SELECT {key}, b, (sum(x*w*c)**2 + sum(x*w*s)**2)/(2*18.0)*CASE WHEN b IN (0,24) THEN 1 ELSE 2 END AS p, b/24.0 AS f FROM fx JOIN tw USING (n) GROUP BY {key}, b),
pts AS (SELECT {key}, f, p, lead(f) OVER w AS f2, lead(p) OVER w AS p2 FROM dens WINDOW w AS (PARTITION BY {key} ORDER BY b)),
bands AS (SELECT 'short' AS band, 1/8.0::DOUBLE AS lo, 1/6.0::DOUBLE AS hi UNION ALL SELECT 'daily', 1/28.0::DOUBLE, 1/20.0::DOUBLE),
area AS (SELECT {key}, band, sum((b-a)*((p+(p2-p)*(a-f)/(f2-f)) + (p+(p2-p)*(b-f)/(f2-f)))/2) AS area FROM (
  SELECT *, greatest(f, lo) AS a, least(f2, hi) AS b FROM pts, bands WHERE f2 IS NOT NULL) WHERE b > a GROUP BY 1, 2),
tot AS (SELECT {key}, sum((f2-f)*(p+p2)/2) AS total FROM pts WHERE f2 IS NOT NULL GROUP BY 1),
shares AS (SELECT t.{key}, CASE WHEN total > 1e-12 THEN s.area/total ELSE 0 END AS fraction_6_8h, CASE WHEN total > 1e-12 THEN d.area/total ELSE 0 END AS fraction_20_28h
 FROM tot t JOIN area s ON s.{key}=t.{key} AND s.band='short' JOIN area d ON d.{key}=t.{key} AND d.band='daily')"""


DAILY = ZPANEL + """,
days AS (SELECT CAST(DATE '2024-01-02' + CAST(i AS INTEGER) AS DATE) AS fd FROM range(0, 28) t(i)),
ctx AS (SELECT z.series || '|' || fd AS k, z.series, fd, z.pos, z.value, z.date = fd AS focal FROM zpanel z JOIN days ON z.date >= fd - 1 AND z.date <= fd + 1),
q AS (SELECT k, quantile_cont(value, 0.1) FILTER (focal) AS p10, quantile_cont(value, 0.9) FILTER (focal) - quantile_cont(value, 0.1) FILTER (focal) AS amp,
 min(pos) AS first_pos, max(pos) AS last_pos FROM ctx GROUP BY k),
lowrows AS (SELECT c.*, p10, amp, first_pos, last_pos, value <= p10 + 0.35*amp AS low FROM ctx c JOIN q USING (k)),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY k ORDER BY pos) AS isl FROM lowrows WHERE low),
lr AS (SELECT k, isl, min(pos) AS start, max(pos)+1 AS stop, any_value(p10) AS p10, any_value(amp) AS amp, any_value(first_pos) AS first_pos, any_value(last_pos) AS last_pos,
 arg_min(focal, pos) AS mine FROM isl GROUP BY k, isl),
ahead AS (SELECT k, pos, max(value) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 16 FOLLOWING) AS peak FROM ctx),
lrp AS (SELECT lr.*, peak, start = first_pos OR stop + 15 > last_pos AS censored, (stop-start)/2 AS hours FROM lr JOIN ahead a ON a.k = lr.k AND a.pos = lr.stop - 1),
ra AS (SELECT k, coalesce(max(hours) FILTER (mine AND NOT censored), 0.0) AS longest, count(*) FILTER (mine AND censored) AS cens,
 coalesce(max(hours) FILTER (mine AND NOT censored AND amp > 0 AND peak > 0 AND peak >= p10 + 0.75*amp), -1) AS best FROM lrp GROUP BY k),
fd AS (SELECT *, value - lag(value) OVER (PARTITION BY k ORDER BY pos) AS d FROM ctx WHERE focal),
lows AS (SELECT k, bool_and(low) FILTER (focal) AS all_low, bool_or(low) FILTER (pos = first_pos) AS starts_low, any_value(amp) AS amp FROM lowrows GROUP BY k),
base AS (SELECT k, any_value(series) AS series, any_value(fd) AS date, greatest(0, max(d)*2) AS ramp, count(*) FILTER (value < 0) AS neg FROM fd GROUP BY k),""" + _periodogram() + """,
joined AS (SELECT b.k, b.series, b.date, 'winter' AS season, CASE WHEN isodow(b.date) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type,
 CAST(b.date - CAST(isodow(b.date) - 1 AS INTEGER) AS DATE) AS week,
 CASE WHEN b.date + 2 <= DATE '2024-01-20' THEN 'development' WHEN b.date - 1 >= DATE '2024-01-20' THEN 'holdout' ELSE 'boundary_purged' END AS phase,
 amp AS p90_minus_p10, ramp AS max_up_ramp_per_hour, neg AS negative_periods, coalesce(longest,0.0) AS longest_low_hours, coalesce(cens,0) AS censored_runs, coalesce(best,-1) AS best,
 fraction_6_8h, fraction_20_28h, NOT (amp > 0 AND ((starts_low AND all_low) OR coalesce(cens,0) > 0)) AS valid_day
 FROM base b JOIN lows USING (k) JOIN shares USING (k) LEFT JOIN ra USING (k)),
daily AS (SELECT *, CASE WHEN valid_day THEN '' ELSE 'censored_run' END AS invalid_reason, CASE WHEN valid_day THEN best >= 6 END AS qualifies_6h,
 CASE WHEN valid_day THEN best >= 8 END AS qualifies_8h FROM joined)"""


def daily(spark, sf):
    return R.daily_features(zero_panel(spark, sf), SEASON, RULE)


@query("local_day_bounds", sql(ZPANEL, """SELECT date, count(*) // count(DISTINCT series) AS slots, CAST(min(epoch(ts)) AS BIGINT) AS starts_at FROM zpanel GROUP BY 1"""))
def day_bounds(spark, sf):
    from ..functions.clock import local_date, slots_between, utc_midnight
    d = panel(spark, sf).select(local_date("ts").alias("date")).distinct()
    return d.select("date", slots_between("date", F.date_add("date", 1)).cast("long").alias("slots"),
                    F.unix_seconds(utc_midnight("date")).alias("starts_at"))


@query("season_phase", sql(DAILY, "SELECT phase, day_type, week, count(*) AS n FROM daily GROUP BY ALL"))
def phases(spark, sf):
    return daily(spark, sf).groupBy("phase", "day_type", "week").agg(F.count("*").alias("n"))


@query("day_context_validity", sql(ZPANEL, """, d AS (SELECT p.series, CAST(DATE '2024-01-02' + CAST(i AS INTEGER) AS DATE) AS date FROM (SELECT DISTINCT series FROM panel) p, range(0,28) t(i)),
c AS (SELECT d.series, d.date, count(p.value) AS known, count(p.value) FILTER (p.date = d.date) AS observed_periods FROM d JOIN panel p ON p.series = d.series AND p.date >= d.date-1 AND p.date <= d.date+1 GROUP BY 1,2)
SELECT series, date, observed_periods, CAST(48 AS INTEGER) AS expected_periods, known < 144 AS missing_context FROM c"""))
def context(spark, sf):
    d = R.daily_features(panel(spark, sf), SEASON, RULE)
    return d.select("series", "date", "observed_periods", "expected_periods",
                    (F.col("invalid_reason") == "missing_context").alias("missing_context"))


@query("daily_profiles", sql(ZPANEL, "SELECT series, date, slot, round(avg(value),6) AS value FROM zpanel GROUP BY 1,2,3"))
def profiles(spark, sf):
    return R.profiles(zero_panel(spark, sf)).withColumn("value", F.round("value", 6))


DAY_FLOATS = ["p90_minus_p10", "max_up_ramp_per_hour", "fraction_6_8h", "fraction_20_28h"]


@query("daily_amplitude_and_spectrum", sql(DAILY, "SELECT series, date, negative_periods, " + ", ".join(f"round({c},6) AS {c}" for c in DAY_FLOATS) + " FROM daily"))
def spectrum(spark, sf):
    return daily(spark, sf).select("series", "date", "negative_periods", *[F.round(c, 6).alias(c) for c in DAY_FLOATS])


@query("daily_low_runs", sql(DAILY, "SELECT series, date, valid_day, invalid_reason, round(longest_low_hours,6) AS longest_low_hours, censored_runs, qualifies_6h, qualifies_8h FROM daily"))
def runs(spark, sf):
    return daily(spark, sf).select("series", "date", "valid_day", "invalid_reason", F.round("longest_low_hours", 6).alias("longest_low_hours"),
                                   "censored_runs", "qualifies_6h", "qualifies_8h")


AGG = """count(*) AS expected_days, count(*) FILTER (valid_day) AS valid_days, round(count(*) FILTER (valid_day)/count(*),6) AS coverage,
 CASE WHEN count(*) FILTER (valid_day) >= 2 AND count(*) FILTER (valid_day)/count(*) >= 0.1 THEN 'sufficient' ELSE 'insufficient_evidence' END AS evidence_status,
 count(*) FILTER (qualifies_6h) AS qualifying_days_6h, count(*) FILTER (qualifies_8h) AS qualifying_days_8h,
 count(*) FILTER (qualifies_6h)/nullif(count(*) FILTER (valid_day),0) AS observed_pattern_frequency_6h,
 count(*) FILTER (qualifies_8h)/nullif(count(*) FILTER (valid_day),0) AS observed_pattern_frequency_8h"""
SUMMARY = DAILY + f""",
phased AS (SELECT * FROM daily UNION ALL SELECT * REPLACE ('all' AS phase) FROM daily),
summary AS (SELECT season, day_type, series, phase, {AGG} FROM phased GROUP BY 1,2,3,4)"""
FREQ = ["coverage", "observed_pattern_frequency_6h", "observed_pattern_frequency_8h"]
COUNTS = ["expected_days", "valid_days", "qualifying_days_6h", "qualifying_days_8h"]


def summary(spark, sf):
    return R.summarize_days(daily(spark, sf), RULE)


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("recurrence_summary", sql(SUMMARY, "SELECT season, day_type, series, phase, evidence_status, " + ", ".join(COUNTS) + ", " + ", ".join(f"round({c},6) AS {c}" for c in FREQ) + " FROM summary"))
def recurrence(spark, sf):
    return rounded(summary(spark, sf).select("season", "day_type", "series", "phase", "evidence_status", *COUNTS, *FREQ), *FREQ)


WEEKLY = DAILY + f""",
weekly AS (SELECT season, day_type, series, week, {AGG} FROM daily GROUP BY 1,2,3,4)"""


def weekly(spark, sf):
    return R.summarize_days(daily(spark, sf), RULE, weekly=True)


@query("weekly_recurrence", sql(WEEKLY, "SELECT season, day_type, series, week, evidence_status, " + ", ".join(COUNTS) + ", " + ", ".join(f"round({c},6) AS {c}" for c in FREQ) + " FROM weekly"))
def weekly_recurrence(spark, sf):
    return rounded(weekly(spark, sf).select("season", "day_type", "series", "week", "evidence_status", *COUNTS, *FREQ), *FREQ)


@query("bootstrap_recurrence_interval", sql(SUMMARY, """, blocks AS (SELECT day_type, series, phase, week, count(*) FILTER (qualifies_6h) AS s, count(*) FILTER (valid_day) AS n,
 row_number() OVER (PARTITION BY day_type, series, phase ORDER BY week) - 1 AS i, count(*) OVER (PARTITION BY day_type, series, phase) AS b FROM phased WHERE valid_day GROUP BY 1,2,3,4),
g AS (SELECT DISTINCT day_type, series, phase, b FROM blocks WHERE b >= 4),
draws AS (SELECT g.*, r, CAST('0x' || substr(md5('7|' || r || '|' || j), 1, 8) AS BIGINT) % b AS i FROM g, range(1, 1001) t(r), LATERAL (SELECT unnest(range(0, b)) AS j)),
ratios AS (SELECT d.day_type, d.series, d.phase, r, sum(s)/sum(n) AS v FROM draws d JOIN blocks k ON k.day_type=d.day_type AND k.series=d.series AND k.phase=d.phase AND k.i=d.i GROUP BY 1,2,3,4)
SELECT day_type, series, phase, round(quantile_cont(v, 0.025),6) AS ci_low_6h, round(quantile_cont(v, 0.975),6) AS ci_high_6h FROM ratios GROUP BY 1,2,3"""))
def bootstrap(spark, sf):
    s = summary(spark, sf).where(F.col("ci_low_6h").isNotNull())
    return rounded(s.select("day_type", "series", "phase", "ci_low_6h", "ci_high_6h"), "ci_low_6h", "ci_high_6h")


SLOTS = SUMMARY + """,
slots AS (SELECT season, d.day_type, phase, d.series, z.slot, median(z.value) AS median, quantile_cont(z.value,0.75)-quantile_cont(z.value,0.25) AS iqr
 FROM daily d JOIN zpanel z ON z.series = d.series AND z.date = d.date WHERE valid_day GROUP BY 1,2,3,4,5)"""


def slots(spark, sf):
    z = zero_panel(spark, sf)
    return R.representative_slots(R.daily_features(z, SEASON, RULE), R.profiles(z))


@query("representative_slots", sql(SLOTS, "SELECT season, day_type, phase, series, slot, round(median,6) AS median, round(iqr,6) AS iqr FROM slots"))
def representative_slots(spark, sf):
    return rounded(slots(spark, sf), "median", "iqr")


@query("representative_behaviour", sql(DAILY, "SELECT season, day_type, phase, series, " + ", ".join(f"round(median({c}),6) AS {c}" for c in R.BEHAVIOUR) + " FROM daily WHERE valid_day GROUP BY 1,2,3,4"))
def behaviour(spark, sf):
    return rounded(R.representative_behaviour(daily(spark, sf)), *R.BEHAVIOUR)


@query("representative_vectors", sql(SLOTS, """SELECT season, day_type, phase, series, CAST(101 AS BIGINT) AS width, round(sum(median),6) AS median_total, round(sum(iqr),6) AS iqr_total FROM slots GROUP BY 1,2,3,4"""))
def vectors(spark, sf):
    z = zero_panel(spark, sf)
    v = R.representative_inputs(R.daily_features(z, SEASON, RULE), R.profiles(z))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), 6)
    return v.select("season", "day_type", "phase", "series", F.size("vector").cast("long").alias("width"),
                    total(F.slice("vector", 1, 48)).alias("median_total"), total(F.slice("vector", 49, 48)).alias("iqr_total"))


COHORT = SLOTS + """,
cohort AS (SELECT season, day_type, series FROM (SELECT season, day_type, series, phase FROM summary WHERE evidence_status='sufficient' AND phase IN ('development','holdout')
 INTERSECT SELECT season, day_type, series, phase FROM slots) GROUP BY 1,2,3 HAVING count(*) = 2)"""


def stored(spark, sf):
    """The day table, written once: every summary, vector and comparison reads it again."""
    return durable(daily(spark, sf))


def cohort(spark, sf):
    d = stored(spark, sf)
    return R.cohort(R.summarize_days(d, RULE), R.representative_inputs(d, R.profiles(zero_panel(spark, sf))))


@query("benchmark_cohort", sql(COHORT, "SELECT * FROM cohort"))
def benchmark_cohort(spark, sf):
    return cohort(spark, sf)


@query("persistence_transfer_score", sql(COHORT, """SELECT a.season, a.day_type, count(DISTINCT a.series) AS n_series, round(sqrt(avg((a.median-b.median)**2)),6) AS later_median_rmse,
 round(avg(abs(a.median-b.median)),6) AS later_median_mae FROM slots a JOIN slots b ON a.season=b.season AND a.day_type=b.day_type AND a.series=b.series AND a.slot=b.slot
 AND a.phase='development' AND b.phase='holdout' JOIN cohort c ON c.season=a.season AND c.day_type=a.day_type AND c.series=a.series GROUP BY 1,2"""))
def persistence(spark, sf):
    d, p = stored(spark, sf), R.profiles(zero_panel(spark, sf))
    members = R.cohort(R.summarize_days(d, RULE), R.representative_inputs(d, p))
    return rounded(R.persistence_score(R.representative_slots(d, p), members), "later_median_rmse", "later_median_mae")


def _transfer(spark, sf):
    """Earlier and later representative vectors; the panel has eight series, so five make a cohort here."""
    d, p = stored(spark, sf), R.profiles(zero_panel(spark, sf))
    vectors, summary = R.representative_inputs(d, p), R.summarize_days(d, RULE)
    return vectors, summary, R.cohort(summary, vectors)


@query("representative_transfer")
def transfer(spark, sf):
    vectors, _, members = _transfer(spark, sf)
    return rounded(T.regime_transfer(vectors, members, minimum=5), "later_median_rmse", "later_median_mae", "reconstruction_mse_scaled")


@query("transfer_persistence", sql(COHORT, """, m AS (SELECT *, CAST('0x' || substr(md5(series), 1, 8) AS BIGINT) % 5 = 0 AS held FROM cohort),
n AS (SELECT season, day_type, count(*) FILTER (NOT held) AS train_series, count(*) FILTER (held) AS test_series FROM m GROUP BY 1,2 HAVING count(*) >= 5)
SELECT n.season, n.day_type, any_value(train_series) AS train_series, any_value(test_series) AS test_series,
 round(sqrt(avg((a.median-b.median)**2)),6) AS later_median_rmse, round(avg(abs(a.median-b.median)),6) AS later_median_mae
FROM n LEFT JOIN m ON m.season=n.season AND m.day_type=n.day_type AND m.held
LEFT JOIN slots a ON a.season=m.season AND a.day_type=m.day_type AND a.series=m.series AND a.phase='development'
LEFT JOIN slots b ON b.season=m.season AND b.day_type=m.day_type AND b.series=m.series AND b.phase='holdout' AND b.slot=a.slot GROUP BY 1,2"""))
def transfer_persistence(spark, sf):
    return transfer(spark, sf).where("model = 'persistence'").drop("representation", "model", "reconstruction_mse_scaled")


@query("transfer_eligibility", sql(COHORT, """SELECT s.season, s.day_type, count(DISTINCT s.series) AS total_series, count(DISTINCT c.series) AS eligible_series,
 count(DISTINCT c.series) >= 10 AS fitted FROM summary s LEFT JOIN cohort c USING (season, day_type, series) GROUP BY 1,2"""))
def transfer_eligibility(spark, sf):
    _, summary, members = _transfer(spark, sf)
    return T.eligibility(summary, members)


@query("regime_summary", sql(SUMMARY, """, pairs AS (SELECT season, day_type, series, max(observed_pattern_frequency_6h) FILTER (phase='development') AS e, max(observed_pattern_frequency_6h) FILTER (phase='holdout') AS l FROM summary GROUP BY 1,2,3),
rk AS (SELECT *, rank() OVER (PARTITION BY season, day_type ORDER BY e) + (count(*) OVER (PARTITION BY season, day_type, e) - 1)/2 AS re,
 rank() OVER (PARTITION BY season, day_type ORDER BY l) + (count(*) OVER (PARTITION BY season, day_type, l) - 1)/2 AS rl FROM pairs WHERE e IS NOT NULL AND l IS NOT NULL),
ag AS (SELECT season, day_type, count(*) AS paired_series, CASE WHEN count(*) >= 3 AND min(e) < max(e) AND min(l) < max(l) THEN corr(re, rl) END AS rho, median(abs(l-e)) AS ch FROM rk GROUP BY 1,2),
f AS (SELECT season, day_type, count(*) AS n_series, count(*) FILTER (evidence_status='sufficient') AS sufficient_series, CAST(sum(valid_days) AS BIGINT) AS valid_series_days,
 CAST(sum(expected_days) AS BIGINT) AS expected_series_days, median(observed_pattern_frequency_6h) AS m6, median(observed_pattern_frequency_8h) AS m8 FROM summary WHERE phase='all' GROUP BY 1,2),
c AS (SELECT season, day_type, count(DISTINCT date) AS calendar_days FROM daily GROUP BY 1,2)
SELECT f.season, f.day_type, n_series, sufficient_series, valid_series_days, expected_series_days, calendar_days, round(m6,6) AS median_recurrence_6h, round(m8,6) AS median_recurrence_8h,
 paired_series, round(rho,6) AS early_late_spearman_6h, round(ch,6) AS median_absolute_change_6h FROM f JOIN c USING (season, day_type) LEFT JOIN ag USING (season, day_type)"""))
def regimes(spark, sf):
    d = stored(spark, sf)
    return rounded(R.regime_summary(d, durable(R.summarize_days(d, RULE))), "median_recurrence_6h", "median_recurrence_8h",
                   "early_late_spearman_6h", "median_absolute_change_6h")


WEEK = SUMMARY + """,
cmp AS (SELECT d.series, count(*) FILTER (date BETWEEN DATE '2024-01-08' AND DATE '2024-01-12') AS reference_expected_days,
 count(*) FILTER (date BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' AND valid_day) AS reference_valid_days,
 avg(CASE WHEN qualifies_6h THEN 1 ELSE 0 END) FILTER (date BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' AND valid_day) AS r6,
 avg(CASE WHEN qualifies_8h THEN 1 ELSE 0 END) FILTER (date BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' AND valid_day) AS r8,
 avg(CASE WHEN qualifies_6h THEN 1 ELSE 0 END) FILTER (NOT date BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' AND valid_day AND day_type='weekday') AS o6 FROM daily d GROUP BY 1),
cmp2 AS (SELECT c.*, s.observed_pattern_frequency_6h AS s6 FROM cmp c LEFT JOIN summary s ON s.series = c.series AND s.phase='all' AND s.day_type='weekday')"""


def week_comparison(spark, sf):
    d = stored(spark, sf)
    return R.reference_week(d, R.summarize_days(d, RULE), "winter", "2024-01-08", "2024-01-12")


@query("reference_week_comparison", sql(WEEK, """SELECT series, reference_expected_days, reference_valid_days, round(r6,6) AS reference_frequency_6h, round(r8,6) AS reference_frequency_8h,
 round(o6,6) AS other_days_frequency_6h, round(s6,6) AS observed_pattern_frequency_6h, round(abs(r6-s6),6) AS absolute_difference_6h, round(abs(r6-o6),6) AS absolute_difference_other_days_6h FROM cmp2"""))
def reference_week(spark, sf):
    c = week_comparison(spark, sf)
    return rounded(c, *[n for n, t in c.dtypes if t == "double"])


@query("reference_week_gap", sql(WEEK, "SELECT count(*) FILTER (abs(r6-o6) >= 0.2) AS series_at_least_limit, round(median(abs(r6-o6)),6) AS median_gap FROM cmp2"))
def reference_gap(spark, sf):
    return rounded(R.reference_gap(durable(week_comparison(spark, sf))), "median_gap")


@query("model_score_summary", sql(COHORT, """, e AS (SELECT a.season, a.day_type, a.series, sqrt(avg((a.median-b.median)**2)) AS rmse FROM slots a JOIN slots b ON a.season=b.season AND a.day_type=b.day_type AND a.series=b.series
 AND a.slot=b.slot AND a.phase='development' AND b.phase='holdout' GROUP BY 1,2,3)
SELECT season, day_type, 'median48' AS representation, 'persistence' AS model, round(avg(rmse),6) AS mean_later_median_rmse, round(stddev_samp(rmse),6) AS sd_later_median_rmse, count(*) AS runs FROM e GROUP BY 1,2"""))
def model_scores(spark, sf):
    s = slots(spark, sf)
    keys = ["season", "day_type", "series", "slot"]
    a = s.where("phase = 'development'").select(*keys, F.col("median").alias("a"))
    b = s.where("phase = 'holdout'").select(*keys, F.col("median").alias("b"))
    err = (F.col("a") - F.col("b"))
    runs = a.join(b, keys).groupBy("season", "day_type", "series").agg(F.sqrt(F.avg(err * err)).alias("later_median_rmse"))
    runs = runs.withColumns({"representation": F.lit("median48"), "model": F.lit("persistence")})
    return rounded(R.model_summary(runs), "mean_later_median_rmse", "sd_later_median_rmse")


@query("weekly_recurrence_matrix", sql(WEEKLY, """, w AS (SELECT series, week, observed_pattern_frequency_6h AS f FROM weekly WHERE day_type = 'weekday')
SELECT series, round(avg(f),6) AS mean_frequency, """ + ", ".join(f"round(max(f) FILTER (week = DATE '{w}'),6) AS \"{w}\"" for w in SEASON.weeks) + " FROM w GROUP BY 1"))
def matrix(spark, sf):
    m = R.weekly_matrix(weekly(spark, sf), SEASON, "weekday")
    return m.select("series", F.round("mean_frequency", 6).alias("mean_frequency"), *[F.round(F.col(f"`{w}`"), 6).alias(w) for w in SEASON.weeks])


@query("recurrence_run_totals", sql(DAILY, "SELECT count(DISTINCT series) AS total_series, count(*) AS daily_rows, count(*) FILTER (valid_day) AS valid_daily_rows FROM daily"))
def totals(spark, sf):
    return R.run_totals(daily(spark, sf))
