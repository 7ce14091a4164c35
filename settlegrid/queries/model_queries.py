"""Per-series and pooled model queries."""
from pyspark.sql import functions as F

from ..operators import forecast as W, models as M, scoring as S
from .forecast_queries import PLAN, covariate
from .inputs import PANEL, ZPANEL, panel, registrar, sql, zero_panel

Q, SQL, query = registrar()

AR = ZPANEL + """,
origins AS (SELECT CAST(672 + 48*i AS INTEGER) AS o FROM range(0, 10) t(i)),
lagged AS (SELECT series, pos, value AS y, lag(value,1) OVER w AS a, lag(value,48) OVER w AS b, lag(value,49) OVER w AS c FROM zpanel WINDOW w AS (PARTITION BY series ORDER BY pos)),
sums AS (SELECT series, o, sum(a*a) AS s11, sum(a*b) AS s12, sum(a*c) AS s13, sum(b*b) AS s22, sum(b*c) AS s23, sum(c*c) AS s33, sum(a*y) AS t1, sum(b*y) AS t2, sum(c*y) AS t3
 FROM lagged JOIN origins ON pos < o WHERE c IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
dets AS (SELECT *, s11*(s22*s33-s23*s23) - s12*(s12*s33-s13*s23) + s13*(s12*s23-s13*s22) AS det FROM sums),
coef AS (SELECT series, o, (t1*(s22*s33-s23*s23) - s12*(t2*s33-t3*s23) + s13*(t2*s23-t3*s22))/det AS ca,
 (s11*(t2*s33-t3*s23) - t1*(s12*s33-s13*s23) + s13*(s12*t3-s13*t2))/det AS cb, (s11*(s22*t3-s23*t2) - s12*(s12*t3-s13*t2) + t1*(s12*s23-s13*s22))/det AS cc FROM dets)"""


@query("seasonal_ar_forecast", sql(AR, """, k AS (SELECT f.series, f.o, l.pos, l.pos - f.o + 1 AS lead, ca, cb*l.b + cc*l.c AS k FROM coef f JOIN lagged l ON l.series = f.series AND l.pos >= f.o AND l.pos < f.o + 48)
SELECT t.series, t.o AS origin_pos, t.pos, round(power(t.ca, t.lead)*y0.y + sum(power(t.ca, t.lead - s.lead)*s.k),4) AS prediction FROM k t JOIN k s ON s.series = t.series AND s.o = t.o AND s.lead <= t.lead
JOIN lagged y0 ON y0.series = t.series AND y0.pos = t.o - 1 GROUP BY t.series, t.o, t.pos, t.lead, t.ca, y0.y"""))
def seasonal_ar(spark, sf):
    p = M.seasonal_ar(zero_panel(spark, sf), PLAN.positions(), 48)
    return p.select("series", "origin_pos", "pos", F.round("prediction", 4).alias("prediction"))


@query("seasonal_ar_gap_coverage", sql(PANEL, """, o AS (SELECT CAST(672 + 48*i AS INTEGER) AS o FROM range(0, 10) t(i)),
lagged AS (SELECT series, pos, value, lag(value,1) OVER w AS a, lag(value,48) OVER w AS b, lag(value,49) OVER w AS c FROM panel WINDOW w AS (PARTITION BY series ORDER BY pos)),
n AS (SELECT series, o, count(value) AS n, count(*) FILTER (value IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL) >= 3 AS fitted,
 count(*) FILTER (value IS NULL AND pos >= o - 49) > 0 AS gap FROM lagged JOIN o ON pos < o GROUP BY 1, 2)
SELECT series, o AS origin_pos, gap, CASE WHEN n >= 336 AND fitted THEN 48 ELSE 0 END AS n_predictions,
 CASE WHEN n < 336 THEN 'insufficient_observations' WHEN fitted THEN '' ELSE 'singular_system' END AS reason FROM n"""))
def ar_gaps(spark, sf):
    """Forecasts of the panel as observed: a gap among the last values and donors costs none of the 48 leads."""
    p = panel(spark, sf)
    d = M.model_diagnostics(M.seasonal_ar(p, PLAN.positions(), 48))
    last = W.at_origins(p.select("series", (F.col("pos") + 49).cast("int").alias("pos"), "value"), PLAN.positions(), 49).groupBy(
        "series", "origin_pos").agg((F.count_if(F.col("value").isNull()) > 0).alias("gap"))
    return d.join(last, ["series", "origin_pos"]).select("series", "origin_pos", "gap", "n_predictions", "reason")


@query("seasonal_ar_gap_forecast")
def ar_gap_forecast(spark, sf):
    return M.seasonal_ar(panel(spark, sf), PLAN.positions(), 48).withColumn("prediction", F.round("prediction", 4))


@query("seasonal_ar_diagnostics", sql(PANEL, """, o AS (SELECT CAST(672 + 48*i AS INTEGER) AS o FROM range(0, 10) t(i)),
n AS (SELECT series, o, count(value) AS n FROM panel JOIN o ON pos < o GROUP BY 1, 2)
SELECT series, o AS origin_pos, n < 560 AS insufficient FROM n"""))
def ar_diagnostics(spark, sf):
    d = M.model_diagnostics(M.seasonal_ar(panel(spark, sf), PLAN.positions(), 48, min_observations=560))
    return d.select("series", "origin_pos", (F.col("reason") == "insufficient_observations").alias("insufficient"))


@query("ets_forecast")
def ets(spark, sf):
    p = M.ets(zero_panel(spark, sf), PLAN.positions(), 48)
    return p.select("series", "origin_pos", "pos", "lead", F.round("prediction", 6).alias("prediction"), "reason")


@query("ets_gap_refusal", sql(PANEL, """, o AS (SELECT CAST(672 + 48*i AS INTEGER) AS o FROM range(0, 10) t(i)),
n AS (SELECT series, o, count(value) AS n, count(*) AS k FROM panel JOIN o ON pos < o GROUP BY 1, 2)
SELECT series, o AS origin_pos, CASE WHEN n < 336 THEN 'insufficient_observations' WHEN n < k THEN 'missing_training_values' ELSE '' END AS reason FROM n"""))
def ets_refusal(spark, sf):
    return M.model_diagnostics(M.ets(panel(spark, sf), PLAN.positions(), 48)).select("series", "origin_pos", "reason")


def pooled(spark, sf, with_covariate=False):
    return M.pooled_backtest(panel(spark, sf), PLAN, covariate=covariate(spark, sf) if with_covariate else None)


@query("pooled_tree_scores")
def pooled_scores(spark, sf):
    s = S.summarize(pooled(spark, sf)[0], ["model", "horizon"])
    return s.withColumns({c: F.round(c, 6) for c, t in s.dtypes if t == "double"})


@query("pooled_tree_with_covariate")
def pooled_covariate(spark, sf):
    s = S.summarize(pooled(spark, sf, True)[0], ["model", "horizon"])
    return s.withColumns({c: F.round(c, 6) for c, t in s.dtypes if t == "double"})


@query("pooled_tree_importance")
def importance(spark, sf):
    s = M.importance_summary(pooled(spark, sf)[1])
    return s.withColumns({c: F.round(c, 6) for c, t in s.dtypes if t == "double"})


@query("training_row_budget", sql(PANEL, "SELECT count(DISTINCT series) * 48 * 9 AS examples FROM panel"))
def row_budget(spark, sf):
    """Examples one fit would build for the series seen, by arithmetic, before building any."""
    n = panel(spark, sf).agg(F.count_distinct("series").alias("n"))
    return n.select((F.col("n") * M.training_row_estimate(1, 1152, M.PooledTree(training_step=96))).alias("examples"))
