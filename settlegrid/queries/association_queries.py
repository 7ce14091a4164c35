"""Association queries over a multi-year daily study made from orders."""
from pyspark.sql import functions as F

from ..operators import association as A, forecast as W, models as M
from ..session import durable
from .forecast_queries import CASES, COVARIATE, PLAN, covariate, features
from .inputs import CALENDAR, panel, registrar, sql, table

Q, SQL, query = registrar()
YEAR = 1995

STUDY = """daily AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS series, sum(o_totalprice)/1000 AS demand FROM orders GROUP BY 1, 2),
warm AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_custkey % 300)/10 AS t FROM orders GROUP BY 1),
study0 AS (SELECT series, date, demand, CASE WHEN day(date) <> 13 THEN t END AS temperature_c, year(date) AS y,
 make_date(year(date), 3, 31) - CAST(isodow(make_date(year(date), 3, 31)) % 7 AS INTEGER) AS bst0,
 CASE WHEN year(date) = 1995 THEN DATE '1995-10-22' ELSE make_date(year(date), 10, 31) - CAST(isodow(make_date(year(date), 10, 31)) % 7 AS INTEGER) END AS bst1 FROM daily JOIN warm USING (date)),
study AS (SELECT series, date, demand, temperature_c, CAST(y AS VARCHAR) AS year, CASE WHEN month(date) IN (12,1,2) THEN 'winter' WHEN month(date) IN (3,4,5) THEN 'spring' WHEN month(date) IN (6,7,8) THEN 'summer' ELSE 'autumn' END AS season,
 CASE WHEN isodow(date) >= 6 THEN 'weekend' ELSE 'weekday' END AS daytype, CASE WHEN date >= bst0 AND date < bst1 THEN '13' ELSE '12' END AS hour FROM study0),
paired AS (SELECT * FROM study WHERE temperature_c IS NOT NULL AND demand IS NOT NULL),
resid AS (SELECT *, demand - avg(demand) OVER w AS dr, temperature_c - avg(temperature_c) OVER w AS tr FROM paired WINDOW w AS (PARTITION BY series, season, hour, daytype)),
first_year AS (SELECT series, avg(demand) AS m, nullif(stddev_pop(demand),0) AS sd FROM study WHERE year = '1995' GROUP BY 1),
z AS (SELECT p.*, (demand - m)/sd AS demand_z, CAST(floor(temperature_c/2)*2+1 AS BIGINT) AS temperature_bin_c FROM paired p LEFT JOIN first_year USING (series))"""


def study(spark, sf):
    o = table(spark, sf, "orders", "o_orderdate", "o_orderpriority", "o_totalprice", "o_custkey").withColumn(
        "ts", F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 12 HOURS"))
    demand = o.groupBy("ts", F.col("o_orderpriority").alias("series")).agg((F.sum("o_totalprice") / 1000).alias("demand"))
    warm = o.groupBy("ts").agg((F.avg(F.col("o_custkey") % 300) / 10).alias("t"))
    return demand.join(warm, "ts").select("series", "ts", "demand", F.when(F.dayofmonth("ts") != 13, F.col("t")).alias("temperature_c"))


def study_z(spark, sf):
    return A.first_year_z(study(spark, sf), YEAR)


def rounded(df, *cols):
    """Round; the shift moves exact decimal ties off the rounding edge."""
    return df.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in cols})


PEARSON = "CASE WHEN count(*) >= 3 AND min({x}) < max({x}) AND min({y}) < max({y}) THEN round(corr({x},{y}),6) END"


@query("guarded_pearson", sql(STUDY, "SELECT series, " + PEARSON.format(x="temperature_c", y="demand") + " AS pearson FROM paired GROUP BY 1"))
def correlation(spark, sf):
    return rounded(A.correlate(study(spark, sf), ["series"]), "pearson")


@query("pooled_spearman", sql(STUDY, """, r AS (SELECT temperature_c AS x, demand AS y, rank() OVER (ORDER BY temperature_c) + (count(*) OVER (PARTITION BY temperature_c) - 1)/2 AS rx,
 rank() OVER (ORDER BY demand) + (count(*) OVER (PARTITION BY demand) - 1)/2 AS ry FROM paired)
SELECT count(*) AS n_paired, round(corr(x, y),6) AS pearson, round(corr(rx, ry),6) AS spearman FROM r"""))
def pooled_spearman(spark, sf):
    from ..functions.ranks import spearman
    return rounded(spearman(study(spark, sf), [], "temperature_c", "demand"), "pearson", "spearman")


@query("calendar_adjusted_residuals", sql(STUDY, "SELECT series, date, round(dr+1e-10,6) AS demand_residual, round(tr+1e-10,6) AS temperature_residual FROM resid"))
def residuals(spark, sf):
    r = A.calendar_residuals(study(spark, sf))
    return rounded(r.select("series", F.to_date("ts").alias("date"), "demand_residual", "temperature_residual"), "demand_residual", "temperature_residual")


@query("first_year_z_score", sql(STUDY, "SELECT series, date, round((demand-m)/sd,6) AS demand_z FROM study LEFT JOIN first_year USING (series)"))
def z_score(spark, sf):
    return study_z(spark, sf).select("series", F.to_date("ts").alias("date"), F.round("demand_z", 6).alias("demand_z"))


@query("temperature_bins", sql(STUDY, """SELECT series, CAST(year AS INTEGER) AS year, season, '12-17' AS hour_band, daytype, temperature_bin_c, count(*) AS n, round(sum(demand),6) AS demand_sum, round(sum(demand_z),6) AS z_sum,
 count(demand_z) AS n_z, round(sum(temperature_c),6) AS temperature_sum FROM z GROUP BY ALL"""))
def bins(spark, sf):
    return rounded(A.binned_sums(study_z(spark, sf)), "demand_sum", "z_sum", "temperature_sum")


@query("temperature_bins_by_hour", sql(STUDY, """SELECT series, CAST(hour AS INTEGER) AS hour, temperature_bin_c, count(*) AS n, round(sum(demand),6) AS demand_sum, round(sum(demand_z),6) AS z_sum, count(demand_z) AS n_z FROM z GROUP BY ALL"""))
def hour_bins(spark, sf):
    return rounded(A.hourly_binned_sums(study_z(spark, sf)), "demand_sum", "z_sum")


def strata(spark, sf):
    s = table(spark, sf, "orders", "o_orderpriority").distinct()
    kind = F.when(F.col("o_orderpriority") < "3", "high").otherwise("low")
    return s.select(F.col("o_orderpriority").alias("series"), kind.alias("stratum"))


def _margins():
    parts = ["SELECT 'overall' AS dimension, 'all' AS level, * FROM z2"]
    parts += [f"SELECT '{m}', CAST({m} AS VARCHAR), * FROM z2" for m in A.MARGINS]
    return STUDY + ", z2 AS (SELECT *, '12-17' AS hour_band, CASE WHEN series < '3' THEN 'high' ELSE 'low' END AS volume_stratum FROM z), fan AS (" + " UNION ALL ".join(parts) + """),
per AS (SELECT dimension, level, temperature_bin_c, series, avg(demand_z) AS mz FROM fan GROUP BY 1,2,3,4)"""


@query("marginal_temperature_curves", sql(_margins(), """SELECT f.*, e.e AS equal_series_mean_demand_z, e.k AS n_series_with_z FROM (
 SELECT dimension, level, temperature_bin_c, count(*) AS n, round(avg(demand)+1e-10,6) AS mean_demand, round(avg(demand_z)+1e-10,6) AS mean_demand_z, round(avg(temperature_c)+1e-10,6) AS mean_temperature FROM fan GROUP BY 1,2,3) f
JOIN (SELECT dimension, level, temperature_bin_c, round(avg(mz),6) AS e, count(mz) AS k FROM per GROUP BY 1,2,3) e USING (dimension, level, temperature_bin_c)"""))
def margins(spark, sf):
    m = A.marginal_curves(A.binned_sums(study_z(spark, sf)), strata(spark, sf))
    return rounded(m, "mean_demand", "mean_demand_z", "mean_temperature", "equal_series_mean_demand_z")


@query("displayed_temperature_curves", sql(_margins(), """, g AS (SELECT dimension, level, temperature_bin_c, count(*) AS n, count(DISTINCT series) FILTER (demand_z IS NOT NULL) AS k FROM fan GROUP BY 1,2,3)
SELECT dimension, level, temperature_bin_c, n, k AS n_series_with_z FROM g WHERE n >= 200 AND k >= 4"""))
def displayed(spark, sf):
    m = A.marginal_curves(A.binned_sums(study_z(spark, sf)), strata(spark, sf))
    return A.displayable(m, 200, 4).select("dimension", "level", "temperature_bin_c", "n", "n_series_with_z")


@query("series_feasibility", sql(STUDY, """SELECT s.series, count(demand) AS n_demand, count(temperature_c) AS n_weather, count(*) FILTER (demand IS NOT NULL AND temperature_c IS NOT NULL) AS n_paired,
 round(count(temperature_c)/count(*),6) AS weather_fraction, round(avg(demand) FILTER (year='1995'),6) AS initial_mean, round(stddev_pop(demand) FILTER (year='1995'),6) AS initial_std,
 round(corr(demand, temperature_c),6) AS pearson, (SELECT round(corr(dr, tr),6) FROM resid r WHERE r.series = s.series) AS calendar_adjusted_pearson,
 CASE WHEN s.series < '3' THEN 'high' ELSE 'low' END AS volume_stratum, CASE WHEN s.series < '3' THEN 0.75::DOUBLE END AS weather_spatial_coverage FROM study s GROUP BY s.series"""))
def feasibility(spark, sf):
    st = strata(spark, sf)
    cover = st.where("stratum = 'high'").select("series", F.lit(0.75).alias("coverage_fraction"))
    f = A.feasibility(study(spark, sf), YEAR, st, cover)
    return rounded(f, "weather_fraction", "initial_mean", "initial_std", "pearson", "calendar_adjusted_pearson")


ASSOC = STUDY + """,
scoped AS (SELECT series, unnest([{'s':'overall','v':'all'},{'s':'season','v':season},{'s':'hour','v':hour},{'s':'daytype','v':daytype},{'s':'year','v':year}]) AS m, temperature_c AS x, demand AS y FROM paired),
alls AS (SELECT series, m.s AS scope, m.v AS slice, x, y FROM scoped UNION ALL SELECT series, 'calendar_adjusted', 'all', tr, dr FROM resid),
ranked AS (SELECT *, rank() OVER (PARTITION BY series, scope, slice ORDER BY x) + (count(*) OVER (PARTITION BY series, scope, slice, x) - 1)/2 AS rx,
 rank() OVER (PARTITION BY series, scope, slice ORDER BY y) + (count(*) OVER (PARTITION BY series, scope, slice, y) - 1)/2 AS ry FROM alls),
assoc AS (SELECT series, scope, slice, count(*) AS n_paired, count(DISTINCT x) AS ux, count(DISTINCT y) AS uy,
 CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS pearson, CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS spearman FROM ranked GROUP BY 1,2,3)"""


@query("association_by_scope", sql(ASSOC, """SELECT series, scope, slice, n_paired, CASE WHEN scope = 'calendar_adjusted' THEN 0 ELSE ux END AS n_unique_temperature,
 round(pearson,6) AS pearson, CASE WHEN scope <> 'calendar_adjusted' THEN round(spearman,6) END AS spearman FROM assoc"""))
def association(spark, sf):
    a = A.association_table(study(spark, sf)).drop("n_unique_demand")
    adjusted = F.col("scope") == "calendar_adjusted"  # residual ties differ in the last bit between engines
    return rounded(a.withColumns({"spearman": F.when(~adjusted, F.col("spearman")),
                                  "n_unique_temperature": F.when(adjusted, 0).otherwise(F.col("n_unique_temperature"))}), "pearson", "spearman")


@query("correlation_distribution", sql(ASSOC, """, long AS (SELECT scope, slice, 'pearson' AS metric, pearson AS r FROM assoc UNION ALL SELECT scope, slice, 'spearman', spearman FROM assoc)
SELECT scope, slice, metric, count(*) AS n_series, count(r) AS n_defined, round(avg(CASE WHEN r < 0 THEN 1 WHEN r IS NOT NULL THEN 0 END),6) AS fraction_negative,
 round(avg(CASE WHEN abs(r) > 0.3 THEN 1 WHEN r IS NOT NULL THEN 0 END),6) AS fraction_abs_above_0_3, round(median(r),6) AS median, round(quantile_cont(r,0.25),6) AS q25, round(quantile_cont(r,0.75),6) AS q75
FROM long WHERE scope <> 'calendar_adjusted' GROUP BY 1,2,3"""))
def distribution(spark, sf):
    s = A.correlation_summary(durable(A.association_table(study(spark, sf)).where("scope != 'calendar_adjusted'")))
    return rounded(s, "fraction_negative", "fraction_abs_above_0_3", "median", "q25", "q75")


@query("bin_medians", sql(STUDY, "SELECT series, temperature_bin_c, count(*) AS n, round(median(demand),6) AS median_demand, round(median(demand_z),6) AS median_demand_z FROM z GROUP BY 1,2"))
def medians(spark, sf):
    return rounded(A.bin_medians(study_z(spark, sf)), "median_demand", "median_demand_z")


SAMPLE = STUDY + """,
sampled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY md5(concat_ws('|', 7, series, CAST(epoch(CAST(date AS TIMESTAMP) + INTERVAL 12 HOUR) AS BIGINT))), date) AS rn FROM z) WHERE rn <= 2000)"""


def sample(spark, sf):
    """The stored association sample (at most 2,000 rows a series)."""
    return durable(A.hourly_sample(study_z(spark, sf)))


@query("hourly_association_sample", sql(SAMPLE, "SELECT series, date, round(demand_z,6) AS demand_z FROM sampled"))
def hourly_sample(spark, sf):
    return sample(spark, sf).select("series", F.to_date("ts").alias("date"), F.round("demand_z", 6).alias("demand_z"))


@query("pooled_sample_correlations", sql(SAMPLE, """, long AS (SELECT unnest([{'s':'overall','v':'all'},{'s':'season','v':season},{'s':'hour','v':hour},{'s':'daytype','v':daytype},{'s':'year','v':year}]) AS m,
 temperature_c AS x, t.target, CASE t.target WHEN 'demand' THEN demand ELSE demand_z END AS y FROM sampled, (SELECT unnest(['demand','demand_z']) AS target) t),
f AS (SELECT m.s AS scope, m.v AS slice, target, x, y FROM long WHERE y IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY scope, slice, target ORDER BY x) + (count(*) OVER (PARTITION BY scope, slice, target, x) - 1)/2 AS rx,
 rank() OVER (PARTITION BY scope, slice, target ORDER BY y) + (count(*) OVER (PARTITION BY scope, slice, target, y) - 1)/2 AS ry FROM f)
SELECT scope, slice, target, count(*) AS n_paired, round(corr(x,y),6) AS pearson, round(corr(rx,ry),6) AS spearman FROM r GROUP BY 1,2,3"""))
def pooled(spark, sf):
    return rounded(A.pooled_correlations(sample(spark, sf)), "pearson", "spearman")


@query("mutual_information")
def mutual_information(spark, sf):
    return rounded(A.mi_table(sample(spark, sf)), *A.MI_COLUMNS[3:])


@query("pooled_mutual_information")
def pooled_mi(spark, sf):
    return rounded(A.pooled_mi(sample(spark, sf)), *A.MI_COLUMNS[3:])


@query("spline_response")
def spline(spark, sf):
    return rounded(A.spline_curves(sample(spark, sf)), "temperature_c", "fitted_demand_z")


@query("year_to_year_stability", sql(ASSOC, """, p AS (SELECT series, max(pearson) FILTER (slice='1995') AS p1, max(pearson) FILTER (slice='1996') AS p2, max(spearman) FILTER (slice='1995') AS s1, max(spearman) FILTER (slice='1996') AS s2
 FROM assoc WHERE scope='year' GROUP BY 1)
SELECT series, round(p1,6) AS pearson_1995, round(p2,6) AS pearson_1996, round(s1,6) AS spearman_1995, round(s2,6) AS spearman_1996, p1 IS NOT NULL AND p2 IS NOT NULL AS pearson_both_defined, sign(p1) = sign(p2) AS pearson_same_sign,
 s1 IS NOT NULL AND s2 IS NOT NULL AS spearman_both_defined, sign(s1) = sign(s2) AS spearman_same_sign FROM p"""))
def stability(spark, sf):
    s = A.year_stability(A.association_table(study(spark, sf)), 1995, 1996)
    return rounded(s, "pearson_1995", "pearson_1996", "spearman_1995", "spearman_1996")


def study_origins(spark, sf):
    """Every study day as an origin."""
    days = study(spark, sf).select(F.to_date("ts").alias("d")).distinct()
    pos = F.date_diff("d", F.lit("1995-01-01").cast("date"))
    return days.select(pos.alias("origin_pos"), F.col("d").cast("timestamp").alias("origin"))


DERANGE = STUDY + """,
o AS (SELECT DISTINCT date_diff('day', DATE '1995-01-01', date) AS origin_pos, season FROM study),
r AS (SELECT *, md5(concat_ws('|', 7, repeat, origin_pos)) AS h FROM o, (SELECT unnest([0,1]) AS repeat)),
donors AS (SELECT repeat, season, origin_pos, coalesce(lag(origin_pos) OVER w, last_value(origin_pos) OVER (PARTITION BY repeat, season ORDER BY h, origin_pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS donor_origin_pos
 FROM r WINDOW w AS (PARTITION BY repeat, season ORDER BY h, origin_pos))"""


@query("season_derangement", sql(DERANGE, "SELECT CAST(repeat AS INTEGER) AS repeat, season, CAST(origin_pos AS BIGINT) AS origin_pos, CAST(donor_origin_pos AS BIGINT) AS donor_origin_pos FROM donors"))
def derangement(spark, sf):
    d = A.season_derangement(study_origins(spark, sf), 2)
    return d.select("repeat", "season", F.col("origin_pos").cast("long").alias("origin_pos"), F.col("donor_origin_pos").cast("long").alias("donor_origin_pos"))


def scored_rows(spark, sf):
    """Backtest targets with a known-future covariate and a transparent linear response to it."""
    rows = W.lookup_covariate(features(spark, sf), covariate(spark, sf))
    return rows.select("series", "origin_pos", "pos", "lead", "target", "target_lag_48", "temperature_c")


def respond(rows):
    return rows.withColumn("prediction", F.col("target_lag_48") + 0.1 * F.coalesce("temperature_c", F.lit(0.0)))


def donors(spark, sf):
    return A.season_derangement(PLAN.folds(spark, CALENDAR), 3)


def detail(spark, sf):
    return A.permutation_detail(scored_rows(spark, sf), donors(spark, sf), respond)


PERMUTE = CASES + COVARIATE + """,
oo AS (SELECT o, r.repeat, md5(concat_ws('|', 7, r.repeat, o)) AS h FROM origins, (SELECT unnest([0,1,2]) AS repeat) r),
dn AS (SELECT repeat, o, coalesce(lag(o) OVER w, last_value(o) OVER (PARTITION BY repeat ORDER BY h, o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS d FROM oo WINDOW w AS (PARTITION BY repeat ORDER BY h, o)),
tt AS (SELECT t.series, t.o, t.pos, t.lead, t.actual, (SELECT value FROM panel p WHERE p.series = t.series AND p.pos = t.pos - 48) AS l48, c.temperature_c AS x FROM targets t LEFT JOIN cov c ON c.series = t.series AND c.ts = t.ts),
pr AS (SELECT a.series, a.o AS origin_pos, repeat, h.horizon, a.actual, a.l48 + 0.1*coalesce(a.x, 0) AS p0, a.l48 + 0.1*coalesce(b.x, 0) AS p1 FROM tt a JOIN dn ON dn.o = a.o LEFT JOIN tt b ON b.series = a.series AND b.o = dn.d AND b.lead = a.lead
 JOIN (SELECT unnest([8,48]) AS horizon) h ON a.lead <= h.horizon),
det AS (SELECT series, origin_pos, repeat, horizon, count(p0 + actual) AS n, coalesce(sum(abs(p0-actual)),0) AS original_abs, coalesce(sum(abs(p1-actual)),0) AS permuted_abs,
 coalesce(sum((p0-actual)**2),0) AS original_squared, coalesce(sum((p1-actual)**2),0) AS permuted_squared FROM pr GROUP BY 1,2,3,4)"""


@query("profile_permutation", sql(PERMUTE, "SELECT series, origin_pos, CAST(repeat AS INTEGER) AS repeat, CAST(horizon AS INTEGER) AS horizon, n, round(original_abs,6) AS original_abs, round(permuted_abs,6) AS permuted_abs FROM det"))
def permutation(spark, sf):
    d = detail(spark, sf).drop("original_squared", "permuted_squared")
    return rounded(d, "original_abs", "permuted_abs")


@query("pooled_permutation_summary")
def pooled_permutation(spark, sf):
    """The same study through the fitted model: every origin's trees score its rows with their own and with lent temperatures."""
    models, rows = M.fit_origins(panel(spark, sf), PLAN, covariate=covariate(spark, sf))
    found = A.permutation_detail(rows, donors(spark, sf), lambda df: M.predict_origins(models, df))
    s = A.permutation_summary(durable(found))
    return rounded(s, *[c for c, t in s.dtypes if t == "double"])


@query("permutation_summary", sql(PERMUTE, """, per AS (SELECT horizon, repeat, sum(original_abs)/sum(n) AS o, sum(permuted_abs)/sum(n) AS p, sqrt(sum(permuted_squared)/sum(n)) - sqrt(sum(original_squared)/sum(n)) AS dr FROM det GROUP BY 1,2)
SELECT CAST(horizon AS INTEGER) AS horizon, round(avg(o),6) AS original_mae, round(avg(p),6) AS mean_permuted_mae, round(avg(p-o),6) AS mean_delta_mae, round(stddev_samp(p-o),6) AS std_delta_mae, round(min(p-o),6) AS min_delta_mae,
 round(max(p-o),6) AS max_delta_mae, round(avg(dr),6) AS mean_delta_rmse, count(*) AS n_repeats FROM per GROUP BY 1"""))
def permutation_summary(spark, sf):
    s = A.permutation_summary(detail(spark, sf))
    return rounded(s, *[c for c, t in s.dtypes if t == "double"])
