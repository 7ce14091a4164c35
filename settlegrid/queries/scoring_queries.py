"""Scoring, matching and benefit queries over the naive cases."""
from pyspark.sql import functions as F

from ..operators import forecast as W, scoring as S
from ..session import durable
from .forecast_queries import CASES, COVARIATE, MODELS, SELECTION, cases, covariate
from .inputs import CALENDAR, panel, registrar, sql

Q, SQL, query = registrar()
PAIR = ("seasonal_48", "seasonal_336")
FLOATS = ("coverage", "mae", "rmse", "mase")

SCORE = """count(*) AS n_cases, count(actual) AS n_observed, count(*) FILTER (actual IS NOT NULL AND prediction IS NOT NULL) AS n_scored,
 count(mase_scale) FILTER (actual IS NOT NULL AND prediction IS NOT NULL) AS n_mase,
 round(count(*) FILTER (actual IS NOT NULL AND prediction IS NOT NULL)/nullif(count(actual),0)+1e-10,6) AS coverage,
 round(avg(abs(prediction-actual))+1e-10,6) AS mae, round(sqrt(avg((prediction-actual)*(prediction-actual)))+1e-10,6) AS rmse,
 round(avg(abs(prediction-actual)/mase_scale)+1e-10,6) AS mase"""
COMMON = CASES + """,
tagged AS (SELECT *, count(*) FILTER (actual IS NOT NULL AND prediction IS NOT NULL) OVER c = 3 AS shared,
 count(*) FILTER (actual IS NOT NULL AND prediction IS NOT NULL AND model <> 'persistence') OVER c = 2 AS shared2
 FROM cases WINDOW c AS (PARTITION BY split, origin_pos, pos, horizon, lead, series)),
common AS (SELECT * REPLACE (CASE WHEN shared THEN prediction END AS prediction) FROM tagged),
paired AS (SELECT * REPLACE (CASE WHEN shared2 THEN prediction END AS prediction) FROM tagged WHERE model <> 'persistence')"""
SLICED = COMMON + """,
sliced AS (SELECT p.*, CASE WHEN isodow(c.ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS daytype, 'winter' AS season FROM paired p JOIN calendar c USING (pos)),"""
SEL = SELECTION[SELECTION.index("init AS"):]


def rounded(df, *cols):
    """Round; the shift moves exact decimal ties (means of cents) off the rounding edge."""
    return df.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in (cols or FLOATS)})


@query("score_summary", sql(CASES, f"SELECT model, split, CAST(horizon AS INTEGER) AS horizon, series, {SCORE} FROM cases GROUP BY 1,2,3,4"))
def summary(spark, sf):
    return rounded(S.summarize(cases(spark, sf)))


@query("score_by_lead", sql(CASES, f"SELECT model, split, CAST(horizon AS INTEGER) AS horizon, lead, {SCORE} FROM cases GROUP BY 1,2,3,4"))
def by_lead(spark, sf):
    return rounded(S.summarize(cases(spark, sf), ("model", "split", "horizon", "lead")))


@query("common_case_scores", sql(COMMON, f"SELECT model, split, CAST(horizon AS INTEGER) AS horizon, {SCORE} FROM common GROUP BY 1,2,3"))
def common(spark, sf):
    return rounded(S.summarize(S.common_cases(cases(spark, sf)), S.BASE))


@query("sufficient_statistics", sql(CASES, """SELECT model, CAST(horizon AS INTEGER) AS horizon, origin_pos, count(*) AS n_cases, count(actual) AS n_observed,
 count(*) FILTER (actual IS NOT NULL AND prediction IS NOT NULL) AS n_scored, count(mase_scale) FILTER (actual IS NOT NULL AND prediction IS NOT NULL) AS n_mase,
 round(coalesce(sum(abs(prediction-actual)),0),6) AS sum_abs, round(coalesce(sum((prediction-actual)**2),0),4) AS sum_squared,
 round(coalesce(sum(abs(prediction-actual)/mase_scale),0),6) AS sum_scaled FROM cases GROUP BY 1,2,3"""))
def sufficient(spark, sf):
    s = S.sufficient_stats(cases(spark, sf), ["model", "horizon", "origin_pos"])
    return s.withColumns({"sum_abs": F.round("sum_abs", 6), "sum_squared": F.round("sum_squared", 4),
                          "sum_scaled": F.round("sum_scaled", 6)})


def selection(spark, sf):
    return W.strata(W.initial_history(panel(spark, sf), 672, 0.1))


def sliced(spark, sf):
    c = S.slice_columns(cases(spark, sf), CALENDAR)
    return c.join(selection(spark, sf).select("series", F.col("stratum").alias("volume_stratum")), "series", "left")


def _tables_sql():
    text = COMMON + "," + SEL + """,
raw_s AS (SELECT p.*, day_type AS daytype, 'winter' AS season, stratum AS volume_stratum FROM tagged p JOIN calendar c USING (pos) JOIN selection USING (series)),
common_s AS (SELECT * REPLACE (CASE WHEN shared THEN prediction END AS prediction) FROM raw_s),
paired_s AS (SELECT * REPLACE (CASE WHEN shared2 THEN prediction END AS prediction) FROM raw_s WHERE model <> 'persistence')"""
    parts = []
    for name, (dims, kind) in S.TABLES.items():
        cols = ", ".join(c if c in dims else f"NULL AS {c}" for c in S.DIMENSIONS)
        group = ", ".join(["model", "split", "horizon", *dims])
        parts.append(f"SELECT '{name}' AS \"table\", model, split, CAST(horizon AS INTEGER) AS horizon, {cols}, {SCORE} FROM {kind}_s GROUP BY {group}")
    return sql(text, " UNION ALL ".join(parts))


@query("metric_tables", _tables_sql())
def metric_tables(spark, sf):
    return rounded(S.metric_tables(durable(sliced(spark, sf)), PAIR, len(MODELS)))  # case rows are a study's stored output


def per_series(spark, sf, dims=()):
    rows = S.common_cases(S.slice_columns(cases(spark, sf), CALENDAR), PAIR)
    return S.summarize(rows, [*S.BASE, "series", *dims])


BENEFIT = SLICED + """
m AS (SELECT split, horizon, series, daytype, model, avg(abs(prediction-actual)) AS mae, count(prediction) FILTER (actual IS NOT NULL) AS n FROM sliced GROUP BY ALL),
benefits AS (SELECT a.split, CAST(a.horizon AS INTEGER) AS horizon, a.series, a.daytype, a.mae AS baseline_mae, b.mae AS model_mae, b.n AS n_paired_cases, a.mae - b.mae AS delta_mae,
 100*(a.mae-b.mae)/nullif(a.mae,0) AS relative_improvement_pct, coalesce(a.mae = 0, false) AS zero_baseline_mae,
 CASE WHEN a.mae-b.mae > 1e-12 THEN 'win' WHEN a.mae-b.mae < -1e-12 THEN 'loss' WHEN a.mae-b.mae IS NOT NULL THEN 'tie' ELSE 'unscored' END AS comparison
 FROM m a JOIN m b ON a.split=b.split AND a.horizon=b.horizon AND a.series=b.series AND a.daytype=b.daytype AND a.model='seasonal_48' AND b.model='seasonal_336')"""
BENEFIT_FLOATS = ("baseline_mae", "model_mae", "delta_mae", "relative_improvement_pct")


def benefits(spark, sf):
    return S.benefit_table(per_series(spark, sf, ("daytype",)), *PAIR, dimensions=("daytype",))


@query("benefit_table", sql(BENEFIT, "SELECT * REPLACE (" + ", ".join(f"round({c},6) AS {c}" for c in BENEFIT_FLOATS) + ") FROM benefits"))
def benefit_table(spark, sf):
    return rounded(benefits(spark, sf), *BENEFIT_FLOATS)


@query("benefit_summary", sql(BENEFIT, """SELECT split, horizon, daytype, count(*) AS n_series, count(*) FILTER (comparison <> 'unscored') AS n_compared,
 round(count(*) FILTER (comparison='win')/nullif(count(*) FILTER (comparison <> 'unscored'),0),6) AS win_fraction,
 round(count(*) FILTER (comparison='loss')/nullif(count(*) FILTER (comparison <> 'unscored'),0),6) AS loss_fraction,
 round(count(*) FILTER (comparison='tie')/nullif(count(*) FILTER (comparison <> 'unscored'),0),6) AS tie_fraction,
 count(relative_improvement_pct) AS n_relative_defined, count(*) FILTER (zero_baseline_mae) AS n_zero_baseline,
 round(avg(baseline_mae),6) AS macro_baseline_mae, round(avg(model_mae),6) AS macro_model_mae,
 round(quantile_cont(relative_improvement_pct,0.5),6) AS median_relative_improvement_pct,
 round(quantile_cont(relative_improvement_pct,0.25),6) AS q25_relative_improvement_pct,
 round(quantile_cont(relative_improvement_pct,0.75),6) AS q75_relative_improvement_pct FROM benefits GROUP BY 1,2,3"""))
def benefit_summary(spark, sf):
    s = S.benefit_summary(durable(benefits(spark, sf)), ["split", "horizon", "daytype"])
    return rounded(s, *[c for c, t in s.dtypes if t == "double"])


def experiments(spark, sf):
    """Two experiments that share the naive baselines: scores of both horizons and of the short one."""
    scored = S.summarize(S.common_cases(cases(spark, sf)), ["model", "horizon"])
    return S.stack_experiments({"full": scored, "repeat": scored.where("horizon = 8")})


@query("ablation_rollup", sql(COMMON, """, s AS (SELECT model, CAST(horizon AS INTEGER) AS horizon, round(avg(abs(prediction-actual)),6) AS mae FROM common GROUP BY 1,2)
SELECT *, 'full' AS experiment FROM s UNION ALL SELECT *, 'repeat' FROM s WHERE horizon = 8"""))
def ablation(spark, sf):
    return experiments(spark, sf).select("model", "horizon", F.round("mae", 6).alias("mae"), "experiment")


@query("ablation_baseline_disagreement", sql(COMMON, """, s AS (SELECT model, CAST(horizon AS INTEGER) AS horizon, avg(abs(prediction-actual)) AS mae FROM common GROUP BY 1,2),
r AS (SELECT model, CAST(horizon AS INTEGER) AS horizon, avg(abs(prediction-actual)) AS mae FROM cases GROUP BY 1,2)
SELECT model, horizon, true AS bad FROM s JOIN r USING (model, horizon) WHERE model <> 'seasonal_336' AND abs(s.mae-r.mae) > 1e-9"""))
def disagreement(spark, sf):
    c = durable(cases(spark, sf))
    stacked = S.stack_experiments({"common": S.summarize(S.common_cases(c), ["model", "horizon"]),
                                   "raw": S.summarize(c, ["model", "horizon"])})
    return S.disagreeing_baselines(stacked, "seasonal_336", columns=("mae",), tol=1e-9)


RAWS = CASES + """,
ps AS (SELECT model, CAST(horizon AS INTEGER) AS horizon, series, avg(abs(prediction-actual)) AS mae, avg(abs(prediction-actual)/mase_scale) AS mase,
 count(mase_scale) FILTER (actual IS NOT NULL AND prediction IS NOT NULL) AS n_mase FROM cases GROUP BY 1,2,3)"""


def raw_per_series(spark, sf):
    return S.summarize(cases(spark, sf), ["model", "horizon", "series"])


@query("mase_contribution_audit", sql(RAWS, """SELECT model, horizon, series, round(mase*n_mase,6) AS scaled_error_sum,
 round(100*mase*n_mase/sum(mase*n_mase) OVER (PARTITION BY model, horizon),6) AS pooled_mase_contribution_pct FROM ps"""))
def contribution(spark, sf):
    return S.mase_contributions(raw_per_series(spark, sf)).select(
        "model", "horizon", "series", F.round("scaled_error_sum", 6).alias("scaled_error_sum"),
        F.round("pooled_mase_contribution_pct", 6).alias("pooled_mase_contribution_pct"))


@query("median_series_mase", sql(RAWS, """SELECT model, horizon, count(mase) AS n_series_mase_defined, round(median(mase),6) AS median_series_mase FROM ps GROUP BY 1,2"""))
def median_mase(spark, sf):
    return rounded(S.median_mase(durable(raw_per_series(spark, sf))), "median_series_mase")


@query("series_mae_by_model", sql(RAWS, """SELECT horizon, series, round(max(mae) FILTER (model='persistence'),6) AS persistence, round(max(mae) FILTER (model='seasonal_48'),6) AS seasonal_48,
 round(max(mae) FILTER (model='seasonal_336'),6) AS seasonal_336,
 round(max(mae) FILTER (model='persistence') - max(mae) FILTER (model='seasonal_336'),6) AS delta_vs_persistence FROM ps GROUP BY 1,2"""))
def mae_by_model(spark, sf):
    return rounded(S.mae_by_model(raw_per_series(spark, sf), MODELS, model="seasonal_336"), *MODELS, "delta_vs_persistence")


@query("training_scale_range", sql(CASES, """SELECT series, round(min(mase_scale),6) AS minimum_training_scale, round(median(mase_scale),6) AS median_training_scale,
 round(max(mase_scale),6) AS maximum_training_scale FROM scales GROUP BY 1"""))
def scale_range(spark, sf):
    r = S.training_scale_range(cases(spark, sf))
    return rounded(r, "minimum_training_scale", "median_training_scale", "maximum_training_scale")


CHANGES = SLICED + """
ps AS (SELECT horizon, series, model, avg(abs(prediction-actual)/mase_scale) AS mase, count(prediction) FILTER (actual IS NOT NULL AND mase_scale IS NOT NULL) AS n FROM sliced GROUP BY 1,2,3),
ch AS (SELECT a.horizon, a.series, a.n, a.mase AS mb, b.mase AS mc, coalesce(b.mase*a.n,0)/sum(a.n) OVER w - coalesce(a.mase*a.n,0)/sum(a.n) OVER w AS d
 FROM ps a JOIN ps b ON a.horizon=b.horizon AND a.series=b.series AND a.model='seasonal_48' AND b.model='seasonal_336' WINDOW w AS (PARTITION BY a.horizon))"""


def changes(spark, sf):
    m = durable(per_series(spark, sf))
    return S.contribution_changes(m.where(F.col("model") == PAIR[0]), m.where(F.col("model") == PAIR[1]))


@query("contribution_changes", sql(CHANGES, "SELECT CAST(horizon AS INTEGER) AS horizon, series, n AS n_base, round(d,6) AS delta_contribution FROM ch"))
def contribution_changes(spark, sf):
    return changes(spark, sf).select("horizon", "series", "n_base", F.round("delta_contribution", 6).alias("delta_contribution"))


@query("leave_one_out_mase", sql(CHANGES, """, top AS (SELECT horizon, first(series ORDER BY d DESC, series) AS excluded_series FROM ch GROUP BY 1)
SELECT CAST(horizon AS INTEGER) AS horizon, excluded_series, CAST(sum(n) AS BIGINT) AS n_mase, round(sum(mb*n)/sum(n),6) AS mase_base, round(sum(mc*n)/sum(n),6) AS mase_candidate
FROM ch JOIN top USING (horizon) WHERE series <> excluded_series GROUP BY 1, 2"""))
def leave_one_out(spark, sf):
    return rounded(S.without_top_contributor(changes(spark, sf)), "mase_base", "mase_candidate")


@query("match_two_runs", sql(CASES, """SELECT series, origin_pos, pos, CAST(horizon AS INTEGER) AS horizon, lead, round(max(actual) FILTER (model = 'seasonal_48'),6) AS actual_reference,
 round(max(prediction) FILTER (model = 'seasonal_48'),6) AS prediction_reference, round(max(prediction) FILTER (model = 'seasonal_336'),6) AS prediction_candidate
 FROM cases WHERE model IN ('seasonal_48', 'seasonal_336') GROUP BY split, series, origin_pos, pos, horizon, lead"""))
def match(spark, sf):
    c = cases(spark, sf)
    m = S.match_cases(c.where(F.col("model") == PAIR[0]), c.where(F.col("model") == PAIR[1]))
    return rounded(m.select("series", "origin_pos", "pos", "horizon", "lead", "actual_reference", "prediction_reference",
                            "prediction_candidate"), "actual_reference", "prediction_reference", "prediction_candidate")


@query("case_mismatch_counts", sql(CASES, """SELECT count(*) FILTER (NOT (lead = 5 AND horizon = 8) AND NOT (lead = 6 AND horizon = 8)) AS matched,
 count(*) FILTER (lead = 5 AND horizon = 8) AS only_reference, count(*) FILTER (lead = 6 AND horizon = 8) AS only_candidate, CAST(0 AS BIGINT) AS duplicated,
 count(*) FILTER (lead = 7 AND actual IS NOT NULL) AS changed_actual, CAST(0 AS BIGINT) AS changed_scale
FROM cases WHERE model = 'seasonal_48'"""))
def mismatches(spark, sf):
    c = cases(spark, sf).where(F.col("model") == PAIR[0])
    ref = c.where(~((F.col("lead") == 6) & (F.col("horizon") == 8)))
    cand = c.where(~((F.col("lead") == 5) & (F.col("horizon") == 8))).withColumn(
        "actual", F.when(F.col("lead") == 7, F.col("actual") + 1).otherwise(F.col("actual")))
    return S.case_mismatches(ref, cand)


COVERAGE = COMMON + "," + SEL + """,
cover AS (SELECT series, CASE series WHEN 'U0' THEN 0.0 WHEN 'U1' THEN 0.4 WHEN 'U2' THEN 0.8 ELSE count(value)/count(*) END AS f FROM panel WHERE series <> 'T_error' GROUP BY 1),
banded AS (SELECT t.*, day_type AS daytype, 'winter' AS season, CASE WHEN hour(c.ts) < 6 THEN '00-05' WHEN hour(c.ts) < 12 THEN '06-11' WHEN hour(c.ts) < 18 THEN '12-17' ELSE '18-23' END AS hour_band,
 stratum AS volume_stratum, CASE WHEN f IS NULL THEN 'no_boundary' WHEN f = 0 THEN 'no_land_overlap' WHEN f < 0.5 THEN 'below_50pct' WHEN f < 0.9 THEN '50_to_90pct' ELSE 'at_least_90pct' END AS weather_coverage_band
 FROM paired t JOIN calendar c USING (pos) LEFT JOIN selection USING (series) LEFT JOIN cover v USING (series))"""


def coverage(spark, sf):
    p = panel(spark, sf).where(F.col("series") != "T_error")
    fixed = F.when(F.col("series") == "U0", 0.0).when(F.col("series") == "U1", 0.4).when(F.col("series") == "U2", 0.8)
    return p.groupBy("series").agg((F.count("value") / F.count("*")).alias("s")).select(
        "series", F.coalesce(fixed, F.col("s")).alias("coverage_fraction"))


def banded(spark, sf):
    return S.add_slices(S.common_cases(cases(spark, sf), PAIR), CALENDAR, selection(spark, sf), coverage(spark, sf))


@query("case_slices", sql(COVERAGE, "SELECT daytype, season, hour_band, volume_stratum, weather_coverage_band, count(*) AS n FROM banded GROUP BY ALL"))
def case_slices(spark, sf):
    return banded(spark, sf).groupBy("daytype", "season", "hour_band", "volume_stratum", "weather_coverage_band").agg(F.count("*").alias("n"))


@query("paired_benefits_by_band", sql(COVERAGE, """, s AS (SELECT split, CAST(horizon AS INTEGER) AS horizon, weather_coverage_band, model, avg(abs(prediction-actual)) AS mae,
 count(*) FILTER (actual IS NOT NULL AND prediction IS NOT NULL) AS n FROM banded GROUP BY 1,2,3,4)
SELECT a.split, a.horizon, a.weather_coverage_band, a.n AS n_scored_base, round(a.mae,6) AS mae_base, round(b.mae,6) AS mae_candidate, round(a.mae-b.mae,6) AS delta_mae,
 round(100*(a.mae-b.mae)/nullif(a.mae,0),6) AS relative_improvement_pct FROM s a JOIN s b ON a.horizon=b.horizon AND a.weather_coverage_band=b.weather_coverage_band
 AND a.model='seasonal_48' AND b.model='seasonal_336'"""))
def by_band(spark, sf):
    b = S.paired_benefits(banded(spark, sf), *PAIR, dimension="weather_coverage_band")
    cols = ["mae_base", "mae_candidate", "delta_mae", "relative_improvement_pct"]
    return rounded(b.select("split", "horizon", "weather_coverage_band", "n_scored_base", *cols), *cols)


@query("paired_win_loss_counts", sql(COMMON, """, s AS (SELECT CAST(horizon AS INTEGER) AS horizon, series, model, avg(abs(prediction-actual)) AS mae,
 count(*) FILTER (actual IS NOT NULL AND prediction IS NOT NULL) AS n FROM paired GROUP BY 1,2,3),
d AS (SELECT a.horizon, a.series, a.mae AS ma, b.mae AS mb, a.mae-b.mae AS d FROM s a JOIN s b ON a.horizon=b.horizon AND a.series=b.series AND a.model='seasonal_48' AND b.model='seasonal_336' WHERE a.n > 0)
SELECT horizon, count(*) AS n_compared, count(*) FILTER (d > 1e-12) AS wins, count(*) FILTER (d < -1e-12) AS losses, count(*) FILTER (abs(d) <= 1e-12) AS ties,
 round(avg(ma),6) AS macro_mae_base, round(avg(mb),6) AS macro_mae_candidate, round(quantile_cont(100*d/nullif(ma,0),0.5),6) AS median_pct,
 round(quantile_cont(100*d/nullif(ma,0),0.25),6) AS q25_pct, round(quantile_cont(100*d/nullif(ma,0),0.75),6) AS q75_pct FROM d GROUP BY 1"""))
def win_loss(spark, sf):
    s = S.paired_counts(durable(S.paired_benefits(S.common_cases(cases(spark, sf), PAIR), *PAIR, dimension="series")))
    return rounded(s, *[c for c, t in s.dtypes if t == "double"])


@query("reserved_target_leakage", sql(CASES, "SELECT origin_pos, count(*) AS n FROM cases WHERE pos >= 1100 GROUP BY 1"))
def leakage(spark, sf):
    return S.leakage(cases(spark, sf), 1100).groupBy("origin_pos").agg(F.count("*").alias("n"))


@query("origin_audit", sql(CASES + COVARIATE, """, j AS (SELECT c.*, v.temperature_c FROM cases c JOIN calendar k USING (pos) LEFT JOIN cov v ON v.series = c.series AND v.ts = k.ts)
SELECT origin_pos, count(DISTINCT series) AS n_series, count(DISTINCT CASE WHEN temperature_c IS NOT NULL THEN series END) AS series_with_covariate, count(*) AS n_cases FROM j GROUP BY 1"""))
def origin_audit(spark, sf):
    return S.origin_audit(cases(spark, sf), covariate(spark, sf))
