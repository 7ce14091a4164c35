"""Gap, fill, quality and masking queries."""
from pyspark.sql import functions as F

from ..operators import features as X, gaps as G, panel as P
from .inputs import PANEL, ZPANEL, panel, registrar, sql, zero_panel

Q, SQL, query = registrar()

# One-slot lines leave the longer gaps to the seasonal donors.
POLICY = G.FillPolicy(linear_max_gap=1)

GATED = PANEL + """,
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY series ORDER BY pos) AS isl FROM panel WHERE value IS NULL),
runlen AS (SELECT series, isl, min(pos) AS start, max(pos)+1 AS stop, count(*) AS n FROM runs GROUP BY 1,2),
share AS (SELECT p.series, count(*) FILTER (value IS NULL)/count(*) AS missing_fraction,
  coalesce(max(l.longest),0) AS longest_run FROM panel p LEFT JOIN (SELECT series, max(n) AS longest FROM runlen GROUP BY 1) l USING (series) GROUP BY 1),
gate AS (SELECT *, missing_fraction <= 0.2 AND longest_run <= 8 AS allowed FROM share)"""
FILLED = GATED + """,
line AS (SELECT r.series, r.pos, a.value + (b.value - a.value) * (r.pos - l.start + 1) / (l.n + 1) AS v
 FROM runs r JOIN runlen l USING (series, isl) JOIN gate g ON g.series = r.series AND g.allowed
 JOIN panel a ON a.series = r.series AND a.pos = l.start - 1 JOIN panel b ON b.series = r.series AND b.pos = l.stop
 WHERE l.n <= 1),
todo AS (SELECT p.* FROM panel p JOIN gate g ON g.series = p.series AND g.allowed
 WHERE value IS NULL AND NOT EXISTS (SELECT 1 FROM line x WHERE x.series = p.series AND x.pos = p.pos)),
dm AS (SELECT series, slot, day_type, date, median(value) AS m FROM panel WHERE value IS NOT NULL GROUP BY ALL),
season AS (SELECT t.series, t.pos, median(d.m) AS v FROM todo t JOIN dm d ON d.series = t.series AND d.slot = t.slot
 AND d.day_type = t.day_type AND d.date <> t.date GROUP BY 1, 2 HAVING count(*) >= 2),
filled AS (SELECT p.series, p.pos, p.ts, p.date, p.value, coalesce(p.value, l.v, s.v) AS filled,
 CASE WHEN l.v IS NOT NULL THEN 'linear' WHEN s.v IS NOT NULL THEN 'seasonal_median' ELSE p.source END AS source
 FROM panel p LEFT JOIN line l USING (series, pos) LEFT JOIN season s USING (series, pos))"""
QUALITY = FILLED + """,
quality AS (SELECT f.series, count(value) AS observed_periods, count(*) FILTER (value IS NULL) AS missing_before,
 count(*) FILTER (value IS NULL)/count(*) AS missing_fraction, CAST(max(s.longest_run) AS BIGINT) AS longest_run,
 count(*) FILTER (value IS NULL AND filled IS NOT NULL) AS imputed, count(*) FILTER (filled IS NULL) AS remaining,
 count(*) FILTER (filled IS NULL) = 0 AND stddev_pop(filled) <= 1e-12 AS constant,
 count(*) FILTER (filled IS NULL) = 0 AS eligible,
 CASE WHEN count(*) FILTER (value IS NULL) = 0 THEN 'observed' WHEN count(*) FILTER (filled IS NULL) = 0 THEN 'imputed'
  ELSE 'insufficient_evidence' END AS status FROM filled f JOIN share s USING (series) GROUP BY f.series)"""


def filled(spark, sf):
    return G.fill_gaps(panel(spark, sf), POLICY)


@query("missing_runs", sql(GATED, """SELECT series, start, CAST(stop AS INTEGER) AS "end", CAST(n AS INTEGER) AS length FROM runlen"""))
def runs(spark, sf):
    return G.missing_runs(panel(spark, sf))


@query("fill_eligibility", sql(GATED, """SELECT series, round(missing_fraction,6) AS missing_fraction,
 CAST(longest_run AS BIGINT) AS longest_run, allowed FROM gate"""))
def eligibility(spark, sf):
    return G.eligibility(panel(spark, sf)).select("series", F.round("missing_fraction", 6).alias("missing_fraction"),
                                                  F.col("longest_run").cast("long").alias("longest_run"), "allowed")


@query("bounded_linear_fill", sql(FILLED.replace("l.n <= 1)", "l.n <= 4)"), "SELECT series, pos, round(v,6) AS filled FROM line"))
def linear(spark, sf):
    out = G.linear_fill(G.gate(panel(spark, sf)))
    return out.where(F.col("source") == "linear").select("series", "pos", F.round("filled", 6).alias("filled"))


@query("seasonal_median_fill", sql(FILLED, "SELECT series, pos, round(v,6) AS filled FROM season"))
def seasonal(spark, sf):
    out = filled(spark, sf).where(F.col("source") == "seasonal_median")
    return out.select("series", "pos", F.round("filled", 6).alias("filled"))


@query("filled_panel", sql(FILLED, "SELECT series, pos, round(filled,6) AS value, source FROM filled"))
def filled_panel(spark, sf):
    return filled(spark, sf).select("series", "pos", F.round("filled", 6).alias("value"), "source")


@query("quality_table", sql(QUALITY, "SELECT * REPLACE (round(missing_fraction,6) AS missing_fraction) FROM quality"))
def quality(spark, sf):
    q = G.quality(filled(spark, sf))
    return q.withColumn("missing_fraction", F.round("missing_fraction", 6))


@query("direction_period_counts", sql(PANEL, """SELECT series, count(*) FILTER (source='observed_import') AS import_periods,
 count(*) FILTER (source='observed_export') AS export_periods FROM panel GROUP BY 1"""))
def directions(spark, sf):
    return G.flow_counts(panel(spark, sf))


@query("missing_mask", sql(PANEL, "SELECT series, pos, value IS NULL AS missing FROM panel"))
def mask(spark, sf):
    return G.missing_mask(panel(spark, sf))


@query("unbounded_linear_fill", sql(PANEL, """, known AS (SELECT series, pos, value FROM panel WHERE value IS NOT NULL),
nb AS (SELECT series, pos, value,
 last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER w1 AS p0, first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER w2 AS p1
 FROM panel WINDOW w1 AS (PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  w2 AS (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT n.series, n.pos, round(CASE WHEN n.value IS NOT NULL THEN n.value WHEN p0 IS NULL THEN b.value WHEN p1 IS NULL THEN a.value
 ELSE a.value + (b.value - a.value) * (n.pos - p0) / (p1 - p0) END, 6) AS filled
FROM nb n LEFT JOIN known a ON a.series = n.series AND a.pos = n.p0 LEFT JOIN known b ON b.series = n.series AND b.pos = n.p1"""))
def unbounded(spark, sf):
    return G.unbounded_linear(panel(spark, sf)).select("series", "pos", F.round("filled", 6).alias("filled"))


def masked(spark, sf):
    return G.mask_patterns(P.complete_series(zero_panel(spark, sf)))


MASKED = ZPANEL + """,
pats AS (SELECT unnest(['random_5pct','random_20pct','block_2h','block_4h','block_6h']) AS pattern),
ranked AS (SELECT z.*, pattern, row_number() OVER (PARTITION BY series, pattern ORDER BY md5(concat_ws('|', 17, series, pattern, pos)), pos) AS rk,
  CAST('0x' || substr(md5(concat_ws('|', '17', series, pattern)), 1, 8) AS BIGINT) AS draw FROM zpanel z CROSS JOIN pats),
masked AS (SELECT *, CASE pattern WHEN 'random_5pct' THEN rk <= 72 WHEN 'random_20pct' THEN rk <= 288
  WHEN 'block_2h' THEN pos >= 1 + draw % 1434 AND pos < 5 + draw % 1434
  WHEN 'block_4h' THEN pos >= 1 + draw % 1430 AND pos < 9 + draw % 1430
  ELSE pos >= 1 + draw % 1426 AND pos < 13 + draw % 1426 END AS masked FROM ranked)"""


@query("artificial_masks", sql(MASKED, """SELECT series, pattern, count(*) FILTER (masked) AS masked_periods,
 round(sum(CASE WHEN masked THEN value END),6) AS hidden FROM masked GROUP BY 1, 2"""))
def masks(spark, sf):
    m = masked(spark, sf)
    return m.groupBy("series", "pattern").agg(F.count_if("masked").alias("masked_periods"),
                                              F.round(F.sum(F.when(F.col("masked"), F.col("truth"))), 6).alias("hidden"))


def features_of(df, by):
    f = X.screen(X.extract_features(df, by), X.ScreenRule(allow_signed_exports=True))
    return f.select(*by, "candidate", "longest_observed_low_hours", "fraction_6_8h")


RECOVERY = MASKED + """,
inc AS (SELECT series, pattern, pos, slot, date, day_type, masked, value AS truth, CASE WHEN NOT masked THEN value END AS value FROM masked),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY series, pattern ORDER BY pos) AS isl FROM inc WHERE value IS NULL),
runlen AS (SELECT series, pattern, isl, min(pos) AS start, max(pos)+1 AS stop, count(*) AS n FROM runs GROUP BY 1,2,3),
gate AS (SELECT series, pattern FROM runlen GROUP BY 1, 2 HAVING sum(n)/1440 <= 0.2 AND max(n) <= 8),
ends AS (SELECT r.series, r.pattern, r.pos, l.n, a.value AS va, b.value AS vb, r.pos - l.start + 1 AS k FROM runs r JOIN runlen l USING (series, pattern, isl)
 LEFT JOIN inc a ON a.series=r.series AND a.pattern=r.pattern AND a.pos = l.start-1
 LEFT JOIN inc b ON b.series=r.series AND b.pattern=r.pattern AND b.pos = l.stop),
dm AS (SELECT series, pattern, slot, day_type, date, median(value) AS m FROM inc WHERE value IS NOT NULL GROUP BY ALL),
season AS (SELECT r.series, r.pattern, r.pos, median(d.m) AS v FROM runs r JOIN dm d ON d.series=r.series AND d.pattern=r.pattern
 AND d.slot=r.slot AND d.day_type=r.day_type AND d.date <> r.date GROUP BY 1,2,3 HAVING count(*) >= 2),
recovered AS (
 SELECT r.series, r.pattern, 'hybrid' AS method, r.pos, r.truth, CASE WHEN g.series IS NULL THEN NULL
   WHEN e.n <= 4 AND va IS NOT NULL AND vb IS NOT NULL THEN va + (vb-va)*k/(n+1) ELSE s.v END AS filled
 FROM runs r JOIN ends e USING (series, pattern, pos) LEFT JOIN gate g ON g.series=r.series AND g.pattern=r.pattern
 LEFT JOIN season s ON s.series=r.series AND s.pattern=r.pattern AND s.pos=r.pos
 UNION ALL
 SELECT r.series, r.pattern, 'unbounded_linear_reference', r.pos, r.truth,
  CASE WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va ELSE va + (vb-va)*k/(n+1) END FROM runs r JOIN ends e USING (series, pattern, pos)),
sds AS (SELECT series, stddev_pop(value) AS sd FROM zpanel GROUP BY 1),
errors AS (SELECT r.series, pattern, method, count(*) AS masked_periods, count(filled) AS filled_periods,
 sqrt(avg((filled-truth)*(filled-truth))) AS rmse, sqrt(avg((filled-truth)*(filled-truth)))/max(sd) AS normalized_rmse
 FROM recovered r JOIN sds USING (series) GROUP BY 1,2,3)"""


@query("mask_recovery_errors", sql(RECOVERY, """SELECT series, pattern, method, masked_periods, filled_periods,
 round(rmse,6) AS rmse, round(normalized_rmse,6) AS normalized_rmse FROM errors"""))
def recovery(spark, sf):
    d = G.recovery_errors(G.recovery(masked(spark, sf)))
    return d.withColumns({"rmse": F.round("rmse", 6), "normalized_rmse": F.round("normalized_rmse", 6)})


@query("mask_recovery_summary", sql(RECOVERY, """SELECT method, pattern, count(*) AS profiles,
 CAST(sum(masked_periods) AS BIGINT) AS masked_periods, CAST(sum(filled_periods) AS BIGINT) AS filled_periods,
 round(avg(normalized_rmse),6) AS mean_normalized_rmse, round(sum(filled_periods)/sum(masked_periods),6) AS filled_fraction
 FROM errors GROUP BY 1, 2"""))
def recovery_summary(spark, sf):
    errors = G.recovery_errors(G.recovery(masked(spark, sf))).withColumn("candidate_changed", F.lit(None).cast("boolean"))
    s = G.recovery_summary(errors).drop("assessed_labels", "label_flip_fraction")
    return s.withColumns({"mean_normalized_rmse": F.round("mean_normalized_rmse", 6),
                          "filled_fraction": F.round("filled_fraction", 6)})
