"""Fold, feature, baseline and case queries."""
from pyspark.sql import functions as F

from ..operators import forecast as W
from .inputs import CALENDAR, N, PANEL, events, panel, registrar, sql

Q, SQL, query = registrar()

PLAN = W.WalkForward(min_train=672, test_pos=1152, n_slots=N)
MODELS = list(W.NAIVE)

CASES = PANEL + """,
origins AS (SELECT CAST(672 + 48*i AS INTEGER) AS o FROM range(0, 10) t(i)),
scales AS (SELECT a.series, o, nullif(avg(abs(a.value - b.value)), 0) AS mase_scale FROM panel a
  JOIN panel b ON b.series = a.series AND b.pos = a.pos - 48 JOIN origins ON a.pos < o GROUP BY 1, 2),
targets AS (SELECT p.series, o, p.pos, p.ts, p.pos - o + 1 AS lead, p.value AS actual, s.mase_scale FROM panel p
  JOIN origins ON p.pos >= o AND p.pos < o + 48 LEFT JOIN scales s USING (series, o)),
models AS (SELECT 'persistence' AS model, 1 AS period UNION ALL SELECT 'seasonal_48', 48 UNION ALL SELECT 'seasonal_336', 336),
cases AS (SELECT model, 'validation' AS split, t.series, o AS origin_pos, t.pos, h.horizon, lead, actual, d.value AS prediction, mase_scale
  FROM targets t CROSS JOIN models JOIN (SELECT unnest([8, 48]) AS horizon) h ON lead <= h.horizon
  LEFT JOIN panel d ON d.series = t.series AND d.pos = o - period + (lead - 1) % period)"""


def cases(spark, sf):
    return W.naive_cases(panel(spark, sf), PLAN)


def origin_frame(spark, sf):
    return PLAN.folds(spark, CALENDAR).unionByName(PLAN.folds(spark, CALENDAR, "test"))


@query("walk_forward_origins", sql(PANEL, """SELECT CASE WHEN p.pos < 1152 THEN 'validation' ELSE 'test' END AS split, p.pos AS origin_pos,
 count(value) AS observed FROM panel p WHERE (p.pos >= 672 AND p.pos + 48 <= 1152 OR p.pos >= 1152 AND p.pos + 48 <= 1440) AND p.pos % 48 = 0 GROUP BY 1, 2"""))
def origins(spark, sf):
    p = panel(spark, sf).select(F.col("pos").alias("origin_pos"), "value")
    return origin_frame(spark, sf).join(p, "origin_pos").groupBy("split", "origin_pos").agg(F.count("value").alias("observed"))


@query("mase_scale_by_origin", sql(CASES, "SELECT DISTINCT series, o AS origin_pos, round(mase_scale,6) AS mase_scale FROM targets"))
def scale(spark, sf):
    rows = W.with_scale(panel(spark, sf)).where(F.col("pos").isin(list(PLAN.positions())))
    return rows.select("series", F.col("pos").alias("origin_pos"), F.round("mase_scale", 6).alias("mase_scale"))


@query("seasonal_naive_cases", sql(CASES, """SELECT model, series, origin_pos, pos, CAST(horizon AS INTEGER) AS horizon, lead,
 round(actual,6) AS actual, round(prediction,6) AS prediction, round(mase_scale,6) AS mase_scale FROM cases"""))
def naive(spark, sf):
    return cases(spark, sf).drop("split").withColumns({c: F.round(c, 6) for c in ("actual", "prediction", "mase_scale")})


@query("short_block_naive", sql(CASES, """SELECT t.series, o AS origin_pos, t.pos, round(d.value,6) AS prediction FROM targets t
 LEFT JOIN panel d ON d.series = t.series AND d.pos = o - 6 + (lead - 1) % 6"""))
def short_naive(spark, sf):
    c = W.naive_cases(panel(spark, sf), PLAN, periods={"six": 6}).where("horizon = 48")
    return c.select("series", "origin_pos", "pos", F.round("prediction", 6).alias("prediction"))


def mean_of_last_day(p, origins, horizon):
    """A user model: the mean of the day before the origin, for every lead."""
    rows = W.build_features(p, origins, horizon, W.FeatureSpec((), (48,), (), 1, (), ()))
    return rows.withColumn("prediction", F.col("mean_48"))


@query("backtest_plugin_model", sql(CASES, """, m AS (SELECT series, o, CASE WHEN count(value) = 48 THEN avg(value) END AS v FROM panel
  JOIN origins ON pos >= o - 48 AND pos < o GROUP BY 1, 2)
SELECT 'day_mean' AS model, t.series, o AS origin_pos, t.pos, CAST(h.horizon AS INTEGER) AS horizon, lead, round(actual,6) AS actual, round(v,6) AS prediction
 FROM targets t LEFT JOIN m USING (series, o) JOIN (SELECT unnest([8, 48]) AS horizon) h ON lead <= h.horizon"""))
def plugin(spark, sf):
    c = W.backtest(panel(spark, sf), PLAN, {"day_mean": mean_of_last_day})
    return c.select("model", "series", "origin_pos", "pos", "horizon", "lead", F.round("actual", 6).alias("actual"),
                    F.round("prediction", 6).alias("prediction"))


def features(spark, sf):
    return W.build_features(panel(spark, sf), PLAN.positions(), 48, holidays=holidays(spark, sf))


def holidays(spark, sf):
    """Dates flagged as holidays when their signups exceed their clicks; weekend dates are left unknown."""
    from ..functions.clock import day_type, local_date
    e = events(spark, sf).groupBy(local_date("ts").alias("date")).agg(
        (F.count_if(F.col("event_type") == "signup") > F.count_if(F.col("event_type") == "click")).alias("is_holiday"))
    return e.where(day_type("date") == "weekday")


@query("origin_lags", sql(CASES, "SELECT t.series, o AS origin_pos, t.pos, " + ", ".join(
    f"round((SELECT value FROM panel p WHERE p.series = t.series AND p.pos = o - {k}),6) AS origin_lag_{k}" for k in (1, 2, 48, 96, 336))
    + " FROM targets t"))
def origin_lags(spark, sf):
    return features(spark, sf).select("series", "origin_pos", "pos",
                                      *[F.round(f"origin_lag_{k}", 6).alias(f"origin_lag_{k}") for k in (1, 2, 48, 96, 336)])


@query("target_lags", sql(CASES, "SELECT t.series, o AS origin_pos, t.pos, " + ", ".join(
    f"round((SELECT value FROM panel p WHERE p.series = t.series AND p.pos = t.pos - {k} AND p.pos < o),6) AS target_lag_{k}"
    for k in (48, 96, 336)) + ", round((SELECT value FROM panel p WHERE p.series = t.series AND p.pos = t.pos - 12 AND p.pos < o),6) AS target_lag_12 FROM targets t"))
def target_lags(spark, sf):
    spec = W.FeatureSpec((), (), (), 1, (12, 48, 96, 336), ())
    f = W.build_features(panel(spark, sf), PLAN.positions(), 48, spec)
    return f.select("series", "origin_pos", "pos", *[F.round(f"target_lag_{k}", 6).alias(f"target_lag_{k}") for k in (12, 48, 96, 336)])


@query("rolling_features", sql(CASES, "SELECT series, o AS origin_pos, " + ", ".join(
    f"round(CASE WHEN count(value) FILTER (pos >= o - {w}) = {w} THEN {fn}(value) FILTER (pos >= o - {w}) END,6) AS {nm}_{w}"
    for nm, fn, w in [("mean", "avg", 6), ("mean", "avg", 12), ("mean", "avg", 48), ("mean", "avg", 336),
                      ("std", "stddev_samp", 48), ("std", "stddev_samp", 336)])
    + " FROM panel JOIN origins ON pos < o AND pos >= o - 336 GROUP BY 1, 2"))
def rolling(spark, sf):
    names = ["mean_6", "mean_12", "mean_48", "mean_336", "std_48", "std_336"]
    return features(spark, sf).where("lead = 1").select("series", "origin_pos", *[F.round(c, 6).alias(c) for c in names])


@query("local_calendar_features", sql(CASES, """SELECT DISTINCT t.pos, CAST(t.pos % 48 + 1 AS INTEGER) AS settlement_period,
 CAST(t.pos % 48 AS INTEGER) AS half_hour_of_day, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts)-1 AS INTEGER) AS day_of_week,
 CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS weekend, CAST(month(ts) AS INTEGER) AS month,
 round(sin(2*pi()*(t.pos % 48)/48),6) AS time_of_day_sin, round(cos(2*pi()*(t.pos % 48)/48),6) AS time_of_day_cos,
 round(sin(2*pi()*(isodow(ts)-1)/7),6) AS day_of_week_sin, round(cos(2*pi()*(isodow(ts)-1)/7),6) AS day_of_week_cos FROM targets t"""))
def calendar(spark, sf):
    names = ["settlement_period", "half_hour_of_day", "hour", "day_of_week", "weekend", "month"]
    waves = ["time_of_day_sin", "time_of_day_cos", "day_of_week_sin", "day_of_week_cos"]
    return features(spark, sf).select("pos", *names, *[F.round(c, 6).alias(c) for c in waves]).distinct()


HOLIDAYS = """,
hol AS (SELECT CAST(ts AS DATE) AS date, CASE WHEN count(*) FILTER (event_type='signup') > count(*) FILTER (event_type='click') THEN 1.0 ELSE 0.0 END AS holiday
 FROM events WHERE isodow(ts) < 6 GROUP BY 1)"""


@query("holiday_flag", sql(CASES + HOLIDAYS, """SELECT series, o AS origin_pos, CAST(h.holiday AS DOUBLE) AS holiday, count(*) AS n
 FROM targets t LEFT JOIN hol h ON h.date = CAST(t.ts AS DATE) GROUP BY 1, 2, 3"""))
def holiday(spark, sf):
    return features(spark, sf).groupBy("series", "origin_pos", "holiday").agg(F.count("*").alias("n"))


EXAMPLES = PANEL + """,
inner_o AS (SELECT CAST(i AS INTEGER) AS o FROM range(336, 1152 - 48 + 1, 96) t(i)),
examples AS (SELECT p.series, o AS origin_pos, p.pos, p.pos - o + 1 AS lead, p.value AS target,
 (SELECT value FROM panel q WHERE q.series = p.series AND q.pos = o - 1) AS origin_lag_1,
 (SELECT value FROM panel q WHERE q.series = p.series AND q.pos = p.pos - 48 AND q.pos < o) AS target_lag_48
 FROM panel p JOIN inner_o ON p.pos >= o AND p.pos < o + 48)"""


def examples(spark, sf):
    return W.training_examples(panel(spark, sf), 1152, step=96)


@query("training_examples", sql(EXAMPLES, """SELECT series, origin_pos, pos, lead, round(target,6) AS target, round(origin_lag_1,6) AS origin_lag_1,
 round(target_lag_48,6) AS target_lag_48 FROM examples"""))
def training(spark, sf):
    return examples(spark, sf).select("series", "origin_pos", "pos", "lead",
                                      *[F.round(c, 6).alias(c) for c in ("target", "origin_lag_1", "target_lag_48")])


@query("training_audit", sql(EXAMPLES, """SELECT count(DISTINCT origin_pos) AS n_inner_origins, count(*) AS n_examples,
 count(target) AS n_observed_targets, count(*) - count(target) AS n_missing_targets, min(pos) AS target_start, max(pos) AS target_end,
 max(origin_pos) AS last_inner_origin FROM examples"""))
def training_audit(spark, sf):
    from ..operators.models import training_audit
    return training_audit(examples(spark, sf))


@query("fit_diagnostics", sql(EXAMPLES, """SELECT series, count(target) AS n_train_examples,
 CASE WHEN count(target) >= 336 THEN 'ok' ELSE 'failed' END AS status,
 CASE WHEN count(target) >= 336 THEN '' ELSE 'insufficient_observed_targets' END AS reason FROM examples GROUP BY 1"""))
def diagnostics(spark, sf):
    from ..operators.models import fit_diagnostics
    return fit_diagnostics(examples(spark, sf), min_targets=336)


@query("trailing_training_window", sql(PANEL, """SELECT series, count(*) AS n, count(value) AS observed, round(sum(value),6) AS total
 FROM panel WHERE pos < 1152 AND pos >= 1152 - 672 GROUP BY 1"""))
def trailing(spark, sf):
    return W.trailing_window(panel(spark, sf), 1152, 672).groupBy("series").agg(
        F.count("*").alias("n"), F.count("value").alias("observed"), F.round(F.sum("value"), 6).alias("total"))


SELECTION = PANEL + """,
init AS (SELECT series, avg(abs(value)) AS mean_absolute_volume, count(value)/count(*) AS observed_fraction FROM panel WHERE pos < 672 GROUP BY 1),
elig AS (SELECT *, observed_fraction >= 0.1 AS eligible FROM init),
rk AS (SELECT series, row_number() OVER (PARTITION BY stratum ORDER BY mean_absolute_volume, series) - 1 AS r,
  count(*) OVER (PARTITION BY stratum) AS n, stratum FROM (SELECT *, CASE ntile(3) OVER (ORDER BY mean_absolute_volume, series) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS stratum
  FROM elig WHERE eligible AND mean_absolute_volume IS NOT NULL)),
selection AS (SELECT e.*, CASE WHEN eligible THEN 'eligible' ELSE 'below_initial_training_coverage' END AS eligibility_reason,
 coalesce(stratum, 'unranked') AS stratum, r, n FROM elig e LEFT JOIN rk USING (series))"""


@query("series_eligibility", sql(SELECTION, """SELECT series, round(mean_absolute_volume,6) AS mean_absolute_volume,
 round(observed_fraction,6) AS observed_fraction, eligible, eligibility_reason FROM selection"""))
def eligibility(spark, sf):
    return W.initial_history(panel(spark, sf), 672, 0.1).withColumns(
        {c: F.round(c, 6) for c in ("mean_absolute_volume", "observed_fraction")})


@query("volume_strata", sql(SELECTION, "SELECT series, stratum FROM selection"))
def strata(spark, sf):
    return W.strata(W.initial_history(panel(spark, sf), 672, 0.1)).select("series", "stratum")


@query("representative_series", sql(SELECTION, """SELECT series, stratum, stratum <> 'unranked' AND (
 stratum = 'low' AND r IN (0, n-1) OR stratum = 'medium' AND r IN (0, n-1) OR stratum = 'high' AND r = 0) AS selected FROM selection"""))
def representatives(spark, sf):
    return W.select_series(panel(spark, sf), 672, 0.1, count=5).select("series", "stratum", "selected")


@query("distributed_total_order", """WITH a AS (SELECT c_custkey, round(c_acctbal, -3) AS bal, c_name FROM customer)
SELECT c_custkey, row_number() OVER (ORDER BY bal, c_name) - 1 AS position, count(*) OVER () AS size FROM a""")
def total_order(spark, sf):
    from ..functions.ranks import ordered_positions
    from .inputs import table
    c = table(spark, sf, "customer", "c_custkey", F.round("c_acctbal", -3).alias("bal"), "c_name")
    return ordered_positions(c, "bal", "c_name").select("c_custkey", F.col("position").cast("long").alias("position"), "size")


COVARIATE = """,
hourly AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1),
cov AS (SELECT series, h AS ts, v AS temperature_c FROM hourly, (SELECT DISTINCT series FROM panel WHERE series <> 'T_error'))"""


def covariate(spark, sf):
    """Hourly mean of view events as each series' outside signal (one series has none)."""
    names = F.array(*[F.lit(s) for s in ("U0", "U1", "U2", "T_view", "T_purchase", "T_signup", "T_click")])
    e = events(spark, sf).where(F.col("event_type") == "view")
    hourly = e.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("temperature_c"))
    return hourly.select(F.explode(names).alias("series"), "ts", "temperature_c").withColumn("pos", CALENDAR.pos("ts"))


@query("known_future_covariate", sql(CASES + COVARIATE, """SELECT t.series, o AS origin_pos, t.pos, round(c.temperature_c,6) AS temperature_c
 FROM targets t LEFT JOIN cov c ON c.series = t.series AND c.ts = t.ts"""))
def known_future(spark, sf):
    f = W.lookup_covariate(features(spark, sf), covariate(spark, sf))
    return f.select("series", "origin_pos", "pos", F.round("temperature_c", 6).alias("temperature_c"))


@query("calendar_slices", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN month(o_orderdate) IN (12,1,2) THEN 'winter' WHEN month(o_orderdate) IN (3,4,5) THEN 'spring'
 WHEN month(o_orderdate) IN (6,7,8) THEN 'summer' ELSE 'autumn' END AS season,
 CASE WHEN isodow(o_orderdate) >= 6 THEN 'weekend' ELSE 'weekday' END AS daytype, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders GROUP BY ALL""")
def slices(spark, sf):
    from ..functions.clock import calendar_slices
    from .inputs import table
    o = table(spark, sf, "orders", "o_orderdate", "o_totalprice").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return calendar_slices(o).groupBy("year", "season", "daytype").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
