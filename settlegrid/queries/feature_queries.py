"""Spectral, low-run and screening queries."""
from pyspark.sql import functions as F

from ..operators import features as X, gaps as G
from ..session import durable
from .gap_queries import QUALITY, RECOVERY, features_of, filled, masked
from .inputs import PANEL, ZPANEL, panel, records, registrar, sql, table, zero_panel

Q, SQL, query = registrar()
BY = ("series",)


def welch_sql(src, key="series"):
    """The full DFT of every segment, as plain joins."""
    return f"""
tw AS (SELECT CAST(k AS INTEGER) AS k, CAST(n AS INTEGER) AS n, cos(2*pi()*k*n/96) AS c, sin(2*pi()*k*n/96) AS s,
 0.5-0.5*cos(2*pi()*n/96) AS w FROM range(0,49) a(k), range(0,96) b(n)),
ext AS (SELECT *, pos - min(pos) OVER (PARTITION BY {key}) AS off, count(*) OVER (PARTITION BY {key}) AS size FROM {src}),
seg AS (SELECT e.*, s.seg, off - s.seg*48 AS n FROM ext e, LATERAL (SELECT unnest([off // 48, off // 48 - 1]) AS seg) s
 WHERE s.seg >= 0 AND s.seg*48 + 96 <= size),
cen AS (SELECT *, value - avg(value) OVER (PARTITION BY {key}, seg) AS x FROM seg),
dft AS (SELECT {key}, seg, k, (sum(x*w*c)**2 + sum(x*w*s)**2) / (2*36.0) * CASE WHEN k IN (0,48) THEN 1 ELSE 2 END AS p
 FROM cen JOIN tw USING (n) GROUP BY {key}, seg, k),
dens AS (SELECT {key}, k, avg(p) AS p, k/48.0 AS f FROM dft GROUP BY {key}, k),
pts AS (SELECT {key}, f, p, lead(f) OVER w AS f2, lead(p) OVER w AS p2 FROM dens WINDOW w AS (PARTITION BY {key} ORDER BY k)),
bands AS (SELECT 'short' AS band, 1/8.0::DOUBLE AS lo, 1/6.0::DOUBLE AS hi UNION ALL SELECT 'daily', 1/28.0::DOUBLE, 1/20.0::DOUBLE),
area AS (SELECT {key}, band, sum((b-a)*((p+(p2-p)*(a-f)/(f2-f)) + (p+(p2-p)*(b-f)/(f2-f)))/2) AS area FROM (
  SELECT *, greatest(f, lo) AS a, least(f2, hi) AS b FROM pts, bands WHERE f2 IS NOT NULL) WHERE b > a GROUP BY 1, 2),
tot AS (SELECT {key}, sum((f2-f)*(p+p2)/2) AS total_power FROM pts WHERE f2 IS NOT NULL GROUP BY 1),
spectral AS (SELECT t.{key}, s.area AS power_6_8h, d.area AS power_20_28h, total_power,
 CASE WHEN total_power > 0 THEN s.area/total_power ELSE 0 END AS fraction_6_8h,
 CASE WHEN total_power > 0 THEN d.area/total_power ELSE 0 END AS fraction_20_28h
 FROM tot t JOIN area s ON s.{key}=t.{key} AND s.band='short' JOIN area d ON d.{key}=t.{key} AND d.band='daily')"""


def temporal_sql(src, low_fraction="0.35", hours="6", key="series"):
    return f"""
q AS (SELECT {key}, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS amp,
 count(*) AS size, min(pos) AS p_first FROM {src} GROUP BY {key}),
lowrows AS (SELECT s.*, p10, amp, size, p_first, value <= p10 + {low_fraction}*amp AS low, {hours} AS hh FROM {src} s JOIN q USING ({key})),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY {key} ORDER BY pos) AS isl FROM lowrows WHERE low),
lr AS (SELECT {key}, isl, min(pos) AS start, max(pos)+1 AS stop, avg(value) AS trough, any_value(p10) AS p10, any_value(amp) AS amp,
 any_value(size) AS size, any_value(p_first) AS p_first, any_value(hh) AS hh FROM isl GROUP BY {key}, isl),
lrp AS (SELECT lr.*, (SELECT max(value) FROM {src} s WHERE s.{key} = lr.{key} AND s.pos >= lr.stop AND s.pos < lr.stop + 16) AS peak,
 start = p_first OR stop + 16 - p_first > size AS censored, (stop-start)/2 AS hours,
 (SELECT date FROM {src} s WHERE s.{key} = lr.{key} AND s.pos = lr.start) AS date FROM lr),
runagg AS (SELECT {key}, max(hours) FILTER (NOT censored) AS longest,
 count(DISTINCT date) FILTER (NOT censored AND amp > 0 AND hours >= hh AND peak > 0 AND peak >= p10 + 0.75*amp) AS qdays,
 count(*) FILTER (NOT censored) AS seen, count(*) FILTER (censored) AS cens,
 max(peak/trough) FILTER (NOT censored AND trough > 0) AS ratio FROM lrp GROUP BY {key}),
diffs AS (SELECT *, value - lag(value) OVER (PARTITION BY {key} ORDER BY pos) AS d FROM {src}),
base AS (SELECT {key}, count(DISTINCT date) AS days, greatest(0, max(d)*2) AS ramp, count(*) FILTER (value < 0) AS neg FROM diffs GROUP BY {key}),
temporal AS (SELECT b.{key}, coalesce(longest, 0.0) AS longest_observed_low_hours, coalesce(qdays,0) AS qualifying_start_days,
 coalesce(qdays,0)/days AS qualifying_day_fraction, coalesce(seen,0) AS observed_low_runs, coalesce(cens,0) AS censored_low_runs,
 ratio AS max_peak_trough_ratio, ramp AS max_up_ramp_per_hour, amp AS p90_minus_p10, neg AS negative_periods
 FROM base b JOIN q USING ({key}) LEFT JOIN runagg USING ({key}))"""


SCREEN = """
screened AS (SELECT *, 0.8*least(greatest(qualifying_day_fraction,0),1) + (1-0.8)*least(greatest(fraction_20_28h,0),1) AS screening_score
 FROM temporal JOIN spectral USING (series)),
labelled AS (SELECT *, qualifying_day_fraction > 0 AND qualifying_day_fraction >= 0.2 AND negative_periods = 0 AND screening_score >= 0.25 AS candidate FROM screened),
final AS (SELECT *, CASE WHEN negative_periods > 0 THEN 'requires_review_negative_volume' WHEN candidate THEN 'candidate' ELSE 'not_flagged' END AS screening_status FROM labelled)"""
ZFEAT = ZPANEL + "," + welch_sql("zpanel") + "," + temporal_sql("zpanel")

SPECTRAL_COLS = ["power_6_8h", "power_20_28h", "total_power"]
SHARE_COLS = ["fraction_6_8h", "fraction_20_28h"]
TEMPORAL_FLOATS = ["longest_observed_low_hours", "qualifying_day_fraction", "max_peak_trough_ratio",
                   "max_up_ramp_per_hour", "p90_minus_p10"]
TEMPORAL_INTS = ["qualifying_start_days", "observed_low_runs", "censored_low_runs", "negative_periods"]


def rounded(df, *extra):
    cols = [c for c in df.columns]
    out = {c: F.round(c, 4) for c in cols if c in SPECTRAL_COLS}
    out |= {c: F.round(c, 6) for c in cols if c in SHARE_COLS + TEMPORAL_FLOATS + list(extra)}
    return df.withColumns(out)


def sel(*cols):
    return ", ".join(f"round({c},4) AS {c}" if c in SPECTRAL_COLS
                     else f"round({c},6) AS {c}" if c in SHARE_COLS + TEMPORAL_FLOATS + ["screening_score"] else c for c in cols)


@query("band_power", sql(ZPANEL + "," + welch_sql("zpanel"), "SELECT series, band, round(area,4) AS area FROM area"))
def band_power(spark, sf):
    s = X.spectral_features(zero_panel(spark, sf))
    return s.select("series", F.explode(F.array(
        F.struct(F.lit("short").alias("band"), F.round("power_6_8h", 4).alias("area")),
        F.struct(F.lit("daily").alias("band"), F.round("power_20_28h", 4).alias("area")))).alias("b")).select("series", "b.*")


@query("welch_spectral_features", sql(ZPANEL + "," + welch_sql("zpanel"),
       "SELECT series, " + sel(*SPECTRAL_COLS, *SHARE_COLS) + " FROM spectral"))
def spectral(spark, sf):
    return rounded(X.spectral_features(zero_panel(spark, sf)).drop("frequency_resolution_cph"))


@query("low_run_detection", sql(ZPANEL + "," + temporal_sql("zpanel"), """SELECT series, start, CAST(stop-start AS BIGINT) AS length,
 round(trough,6) AS trough, round(CASE WHEN NOT censored THEN peak END,6) AS following_peak, censored FROM lrp"""))
def low_runs(spark, sf):
    r = X.temporal_rows(zero_panel(spark, sf)).where("_start")
    return r.select("series", F.col("pos").alias("start"), F.col("_len").alias("length"), F.round("_trough", 6).alias("trough"),
                    F.round(F.when(~F.col("_censored"), F.col("_peak")), 6).alias("following_peak"),
                    F.col("_censored").alias("censored"))


@query("temporal_features", sql(ZPANEL + "," + temporal_sql("zpanel"),
       "SELECT series, " + sel(*TEMPORAL_FLOATS, *TEMPORAL_INTS) + " FROM temporal"))
def temporal(spark, sf):
    return rounded(X.temporal_features(zero_panel(spark, sf)))


@query("feature_table", sql(ZFEAT, "SELECT series, " + sel(*SPECTRAL_COLS, *SHARE_COLS, *TEMPORAL_FLOATS, *TEMPORAL_INTS)
       + " FROM temporal JOIN spectral USING (series)"))
def feature_table(spark, sf):
    return rounded(X.extract_features(zero_panel(spark, sf)).drop("frequency_resolution_cph"))


@query("screening_score", sql(ZFEAT + "," + SCREEN, "SELECT series, " + sel("screening_score") + ", candidate, screening_status FROM final"))
def score(spark, sf):
    s = X.screen(X.extract_features(zero_panel(spark, sf)))
    return s.select("series", F.round("screening_score", 6).alias("screening_score"), "candidate", "screening_status")


READY = QUALITY + """,
ready AS (SELECT series, pos, date, filled AS value FROM filled WHERE series IN (SELECT series FROM quality WHERE eligible)),"""
FULL_SCREEN = READY + welch_sql("ready") + "," + temporal_sql("ready") + "," + SCREEN + """,
joined AS (SELECT q.series, q.status, q.eligible, CASE WHEN q.eligible THEN f.candidate END AS candidate,
 CASE WHEN NOT q.eligible THEN 'insufficient_evidence' WHEN q.status = 'imputed' THEN f.screening_status || '_imputed' ELSE f.screening_status END AS screening_status,
 f.screening_score FROM quality q LEFT JOIN final f USING (series))"""


def screened(spark, sf):
    f = durable(filled(spark, sf))  # the filled panel is a stored output; quality and features both read it
    return X.screen_with_quality(f, G.quality(f))


@query("screening_with_quality", sql(FULL_SCREEN, "SELECT series, status, candidate, screening_status, round(screening_score,6) AS screening_score FROM joined"))
def screen_quality(spark, sf):
    return screened(spark, sf).select("series", "status", "candidate", "screening_status",
                                      F.round("screening_score", 6).alias("screening_score"))


def boundaries(spark, sf):
    """Boundary ids: the user groups and one per nation region, so some match and some do not."""
    users = records(spark, sf).where(~F.col("series").isin("T_view", "T_click")).select("series").distinct()
    return users.union(table(spark, sf, "region").select(F.col("r_name").alias("series")))


BOUNDS = """,
bounds AS (SELECT DISTINCT series FROM records WHERE series NOT IN ('T_view','T_click') UNION ALL SELECT r_name FROM region)"""


@query("screening_map", sql(FULL_SCREEN + BOUNDS, """SELECT b.series, screening_status, CASE screening_status
 WHEN 'candidate' THEN '#007f73' WHEN 'not_flagged' THEN '#b0bac5' WHEN 'requires_review_negative_volume' THEN '#dc933b'
 WHEN 'candidate_imputed' THEN '#43b6a7' WHEN 'not_flagged_imputed' THEN '#8599bb'
 WHEN 'requires_review_negative_volume_imputed' THEN '#dc933b' WHEN 'insufficient_evidence' THEN '#dc933b' ELSE '#eeeeee' END AS map_color
 FROM bounds b LEFT JOIN joined USING (series)"""))
def screen_map(spark, sf):
    return X.map_status(boundaries(spark, sf), screened(spark, sf))


@query("unmatched_map_series", sql(PANEL + BOUNDS, "SELECT DISTINCT series FROM panel WHERE series NOT IN (SELECT series FROM bounds)"))
def unmatched(spark, sf):
    return X.unmatched_series(panel(spark, sf).select("series").distinct(), boundaries(spark, sf))


GRID = ZPANEL + """,
grid AS (SELECT series || '|' || lf || '|' || h AS k, series, CAST(lf AS DOUBLE) AS lf, h, pos, date, value FROM zpanel,
 (SELECT unnest([0.25,0.35,0.45]) AS lf), (SELECT unnest([6,8]) AS h)),""" + temporal_sql("grid", "s.lf", "s.h", "k") + """,
feats AS (SELECT DISTINCT g.lf AS low_fraction, g.h AS min_low_hours, g.series, t.qualifying_day_fraction AS f, t.negative_periods AS neg
 FROM temporal t JOIN (SELECT DISTINCT k, series, lf, h FROM grid) g USING (k)),""" + welch_sql("zpanel")


@query("threshold_sensitivity", sql(GRID, """, lab AS (SELECT CAST(low_fraction AS DOUBLE) AS low_fraction, min_low_hours, t.score_threshold, series,
 f > 0 AND f >= 0.2 AND neg = 0 AND 0.8*least(f,1) + (1-0.8)*least(fraction_20_28h,1) >= t.score_threshold AS candidate
 FROM feats JOIN spectral USING (series) CROSS JOIN (SELECT unnest([0.15,0.25,0.35])::DOUBLE AS score_threshold) t)
SELECT l.low_fraction, l.min_low_hours, l.score_threshold, count(*) FILTER (l.candidate) AS candidate_count,
 count(*) FILTER (l.candidate <> d.candidate) AS changed_vs_default, count(*) AS total_series
FROM lab l JOIN lab d ON d.series = l.series AND d.low_fraction = 0.35 AND d.min_low_hours = 6 AND d.score_threshold = 0.25 GROUP BY 1,2,3"""))
def sensitivity(spark, sf):
    return X.sensitivity(zero_panel(spark, sf))


LEGACY = ZPANEL + """,
unsigned AS (SELECT series, pos, abs(value) AS y FROM zpanel),
bins AS (SELECT series, k, (sum(y*cos(2*pi()*k*pos/1440))**2 + sum(y*sin(2*pi()*k*pos/1440))**2) AS p FROM unsigned, range(0, 721) t(k) GROUP BY 1, 2),
norm AS (SELECT series, k, p / max(p) OVER (PARTITION BY series) AS p FROM bins),
psd AS (SELECT series, sum(p * w) / (3*1440) AS int_psd FROM norm JOIN (SELECT abs(i) AS k, CASE WHEN abs(i) = 6 THEN 1 WHEN abs(i) % 2 = 1 THEN 4 ELSE 2 END AS w
  FROM range(-6, 7) r(i)) USING (k) GROUP BY 1)"""


def unsigned(spark, sf):
    return zero_panel(spark, sf).withColumn("value", F.abs("value"))


@query("legacy_integrated_psd", sql(LEGACY, "SELECT series, round(int_psd,9) AS int_psd FROM psd"))
def legacy(spark, sf):
    return X.legacy_low_frequency_psd(unsigned(spark, sf)).withColumn("int_psd", F.round("int_psd", 9))


@query("legacy_psd_class", sql(LEGACY, "SELECT series, CAST(CASE WHEN int_psd <= 0.0034 THEN 1 ELSE 2 END AS INTEGER) AS psd_index FROM psd"))
def legacy_class(spark, sf):
    psd = X.legacy_low_frequency_psd(unsigned(spark, sf))
    return X.legacy_class(psd, X.LEGACY_THRESHOLDS["weekdays"]).select("series", "psd_index")


# Copies that are complete again and the truth itself, as series of their own.
AGAIN = """,
back AS (SELECT series, pattern, method FROM recovered GROUP BY 1, 2, 3 HAVING count(*) = count(filled)),
again AS (SELECT concat_ws('|', m.series, m.pattern, b.method) AS series, m.pos, m.date, CASE WHEN m.masked THEN r.filled ELSE m.value END AS value
 FROM back b JOIN masked m USING (series, pattern)
 LEFT JOIN recovered r ON r.series = m.series AND r.pattern = m.pattern AND r.method = b.method AND r.pos = m.pos
 UNION ALL SELECT series, pos, date, value FROM zpanel),""" + welch_sql("again") + "," + temporal_sql("again") + """,
judged AS (SELECT *, qualifying_day_fraction >= 0.2 AND 0.8*least(greatest(qualifying_day_fraction,0),1)
 + (1-0.8)*least(greatest(fraction_20_28h,0),1) >= 0.25 AS candidate FROM temporal JOIN spectral USING (series)),
changes AS (SELECT b.series, b.pattern, b.method, c.candidate <> t.candidate AS changed,
 c.longest_observed_low_hours - t.longest_observed_low_hours AS low_error, c.fraction_6_8h - t.fraction_6_8h AS band_error
 FROM back b JOIN judged c ON c.series = concat_ws('|', b.series, b.pattern, b.method) JOIN judged t ON t.series = b.series)"""


@query("mask_label_changes", sql(RECOVERY, AGAIN + """
SELECT method, pattern, count(*) AS profiles, CAST(sum(masked_periods) AS BIGINT) AS masked_periods,
 CAST(sum(filled_periods) AS BIGINT) AS filled_periods, round(avg(normalized_rmse),6) AS mean_normalized_rmse,
 count(changed) AS assessed_labels, round(avg(CAST(changed AS INTEGER)),6) AS label_flip_fraction,
 round(sum(filled_periods)/sum(masked_periods),6) AS filled_fraction
FROM errors LEFT JOIN changes USING (series, pattern, method) GROUP BY 1, 2"""))
def label_changes(spark, sf):
    s = G.recovery_summary(G.recovery_details(durable(masked(spark, sf)), feature_fn=features_of))
    return s.withColumns({c: F.round(c, 6) for c in ("mean_normalized_rmse", "label_flip_fraction", "filled_fraction")})


@query("mask_feature_errors", sql(RECOVERY, AGAIN + """
SELECT series, pattern, method, changed AS candidate_changed, round(low_error,6) AS low_duration_error_hours,
 round(band_error,6) AS band_fraction_error FROM errors LEFT JOIN changes USING (series, pattern, method)"""))
def feature_errors(spark, sf):
    d = G.recovery_details(durable(masked(spark, sf)), feature_fn=features_of)
    return d.select("series", "pattern", "method", "candidate_changed", F.round("low_duration_error_hours", 6).alias("low_duration_error_hours"),
                    F.round("band_fraction_error", 6).alias("band_fraction_error"))
