"""Records, panel and audit queries."""
from pyspark.sql import functions as F

from ..operators import panel as P, revisions as R
from ..sources import panels as S, records as SR
from .inputs import CALENDAR, PANEL, RECORDS, RESOLVED, panel, records, registrar, sql, table

Q, SQL, query = registrar()


def raw_text(spark, sf):
    """The records as the text columns a meter file holds."""
    r = records(spark, sf)
    return r.select("series", F.date_format("settle_date", "yyyyMMdd").alias("settle_date"),
                    F.col("period").cast("string").alias("period"),
                    F.date_format("rev_agg", "yyyyMMdd").alias("rev_agg"),
                    F.date_format("rev_flow", "yyyyMMdd").alias("rev_flow"),
                    F.col("rev_run").cast("string").alias("rev_run"), F.col("volume").cast("string").alias("volume"),
                    "flow", F.when(F.col("estimated"), "T").otherwise("F").alias("estimated"),
                    F.col("flow").alias("source"))


@query("record_scan_window_direction", sql(RECORDS, """
SELECT series, settle_date, CAST(count(*) AS BIGINT) AS n, round(sum(volume),6) AS volume,
 CAST(sum(CASE WHEN estimated THEN 1 ELSE 0 END) AS BIGINT) AS n_estimated
FROM records WHERE settle_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' AND flow='I' GROUP BY ALL"""))
def record_scan(spark, sf):
    r = R.parse_records(SR.by_direction(SR.by_settlement_date(raw_text(spark, sf), "2024-01-08", "2024-01-21"), "I"))
    return r.groupBy("series", "settle_date").agg(
        F.count("*").alias("n"), F.round(F.sum("volume"), 6).alias("volume"), F.count_if("estimated").alias("n_estimated"))


INVENTORY = RECORDS + """, coverage AS (SELECT flow AS source, settle_date, count(*) AS raw_rows FROM records GROUP BY ALL)"""


def coverage(spark, sf):
    return SR.source_coverage(records(spark, sf).withColumnRenamed("flow", "source"))


@query("source_date_inventory", sql(INVENTORY, "SELECT source, settle_date, CAST(raw_rows AS BIGINT) raw_rows FROM coverage"))
def source_dates(spark, sf):
    return coverage(spark, sf)


@query("source_date_spans", sql(INVENTORY, """SELECT source, CAST(sum(raw_rows) AS BIGINT) AS rows,
 min(settle_date) AS settlement_start, max(settle_date) AS settlement_end FROM coverage GROUP BY 1"""))
def source_spans(spark, sf):
    return SR.source_spans(coverage(spark, sf))


@query("settlement_date_totals", sql(INVENTORY,
       "SELECT settle_date, CAST(sum(raw_rows) AS BIGINT) AS raw_rows FROM coverage GROUP BY 1"))
def date_totals(spark, sf):
    return SR.date_coverage(coverage(spark, sf))


@query("sources_touching_window", sql(RECORDS, """, spans AS (SELECT series || '/' || ((day(settle_date) - 1) // 7) AS source, count(*) AS rows,
 min(settle_date) AS settlement_start, max(settle_date) AS settlement_end FROM records GROUP BY 1)
SELECT source, CAST(rows AS BIGINT) AS rows, settlement_start, settlement_end FROM spans
WHERE settlement_end >= DATE '2024-01-02' AND settlement_start <= DATE '2024-01-02'"""))
def window_sources(spark, sf):
    """Each series delivers one source a week; those of other weeks need not be read."""
    week = F.floor((F.dayofmonth("settle_date") - 1) / 7).cast("string")
    r = records(spark, sf).drop("flow").withColumn("source", F.concat_ws("/", "series", week))
    spans = SR.source_spans(SR.source_coverage(r))
    d = F.lit("2024-01-02").cast("date")
    return SR.sources_in_window(spans, d, d)


@query("latest_revision", sql(RESOLVED, """SELECT series, settle_date, period, round(volume,6) AS volume, flow,
 CAST(n_rows AS BIGINT) AS n_rows FROM resolved"""))
def latest_revision(spark, sf):
    return R.resolve_revisions(R.sign_volumes(records(spark, sf))).select(
        "series", "settle_date", "period", F.round("volume", 6).alias("volume"), "flow", "n_rows")


ITEM_KEY = dict(key=["l_orderkey", "l_linenumber"], revision=["l_shipdate"], value="l_quantity", flow=None, keep=())


@query("conflicting_revisions", """
WITH ranked AS (SELECT *, rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC) AS rk FROM lineitem)
SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM ranked WHERE rk = 1 GROUP BY 1, 2
HAVING count(DISTINCT l_quantity) + max(CASE WHEN l_quantity IS NULL THEN 1 ELSE 0 END) > 1""")
def conflicting(spark, sf):
    items = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return R.conflicting_keys(items, **ITEM_KEY).select("l_orderkey", "l_linenumber", "l_quantity")


@query("latest_revision_repeated_keys", """
WITH ranked AS (SELECT *, rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC) AS rk,
 count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n_rows FROM lineitem)
SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, CAST(max(n_rows) AS BIGINT) AS n_rows FROM ranked
WHERE rk = 1 GROUP BY 1, 2""")
def repeated_keys(spark, sf):
    items = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return R.latest_candidates(items, **ITEM_KEY).select("l_orderkey", "l_linenumber", "l_quantity", "n_rows")


@query("record_rule_violations", sql(RECORDS, """
SELECT CAST(0 AS BIGINT) AS missing_series, CAST(0 AS BIGINT) AS missing_date,
 CAST(sum(CASE WHEN period > 40 THEN 1 ELSE 0 END) AS BIGINT) AS bad_date,
 CAST(sum(CASE WHEN period < 5 THEN 1 ELSE 0 END) AS BIGINT) AS bad_period,
 CAST(sum(CASE WHEN flow = 'E' THEN 1 ELSE 0 END) AS BIGINT) AS bad_volume, CAST(0 AS BIGINT) AS bad_revision
FROM records"""))
def rule_violations(spark, sf):
    from ..checks import violations
    raw = raw_text(spark, sf)
    p = F.col("period").cast("int")
    dirty = raw.withColumns({
        "settle_date": F.when(p > 40, "20240230").otherwise(F.col("settle_date")),
        "volume": F.when(F.col("flow") == "E", F.lit("Infinity")).otherwise(F.col("volume")),
        "period": F.when(p < 5, F.concat("period", F.lit(".5"))).otherwise(F.col("period"))})
    return violations(dirty, R.record_violations(dirty))


@query("signed_volumes", sql(RECORDS, """SELECT series, flow, CAST(count(*) AS BIGINT) AS n,
 round(sum(CASE WHEN flow='E' THEN -volume ELSE volume END),6) AS volume FROM records GROUP BY ALL"""))
def signed(spark, sf):
    return R.sign_volumes(records(spark, sf)).groupBy("series", "flow").agg(
        F.count("*").alias("n"), F.round(F.sum("volume"), 6).alias("volume"))


@query("settlement_calendar_days", sql(RECORDS, """, days AS (SELECT min(settle_date) a, max(settle_date) b FROM records),
slots AS (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) + INTERVAL 1410 MINUTE, INTERVAL 30 MINUTE)) AS t FROM days)
SELECT settle_date, count(*) AS periods, CAST(sum(raw) AS BIGINT) AS raw_rows FROM (
 SELECT CAST(t AS DATE) AS settle_date, t, (SELECT count(*) FROM records r WHERE r.settle_date = CAST(t AS DATE)
   AND r.period = hour(t)*2 + floor(minute(t)/30) + 1) AS raw FROM slots) GROUP BY 1"""))
def calendar_days(spark, sf):
    r = records(spark, sf).groupBy("settle_date", "period").agg(F.count("*").alias("n"))
    return CALENDAR.frame(spark).join(r, ["settle_date", "period"], "left").groupBy("settle_date").agg(
        F.count("*").alias("periods"), F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"))


@query("records_outside_calendar", sql(RECORDS, """SELECT settle_date, CAST(count(*) AS BIGINT) AS n FROM records
WHERE settle_date NOT BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 1"""))
def outside(spark, sf):
    from ..functions.clock import SettlementCalendar
    week = SettlementCalendar("2024-01-08", "2024-01-14")
    return P.outside_calendar(records(spark, sf), week).groupBy("settle_date").agg(F.count("*").alias("n"))


@query("dense_panel", sql(PANEL, "SELECT series, pos, round(value,6) AS value, source FROM panel"))
def dense(spark, sf):
    return panel(spark, sf).select("series", "pos", F.round("value", 6).alias("value"), "source")


@query("panel_audit", sql(PANEL, """SELECT (SELECT count(*) FROM records) AS input_rows,
 (SELECT count(*) FROM resolved) AS resolved_rows,
 (SELECT count(*) FROM records) - (SELECT count(*) FROM resolved) AS superseded_or_duplicate_rows,
 count(DISTINCT series) AS total_series, CAST(1440 AS BIGINT) AS periods_per_series,
 count(*) FILTER (source='observed_import') AS observed_import_periods,
 count(*) FILTER (source='observed_export') AS observed_export_periods,
 count(*) FILTER (value IS NULL) AS genuinely_missing_periods,
 count(*) FILTER (estimated) AS estimated_rows_after_resolution FROM panel"""))
def audit(spark, sf):
    return P.panel_audit(records(spark, sf), CALENDAR)


@query("daily_audit", sql(RESOLVED, """SELECT settle_date, CAST(sum(n_rows) AS BIGINT) AS input_rows,
 count(*) AS resolved_rows, count(DISTINCT series) AS total_series,
 count(*) FILTER (flow='I') AS observed_import_periods, count(*) FILTER (flow='E') AS observed_export_periods,
 count(*) FILTER (estimated) AS estimated_rows FROM resolved GROUP BY 1"""))
def daily(spark, sf):
    return P.daily_audit(records(spark, sf))


@query("observed_by_month", sql(PANEL, """SELECT series, strftime(ts, '%Y-%m') AS month, count(value) AS observed
FROM panel GROUP BY ALL"""))
def by_month(spark, sf):
    return P.observed_by_month(panel(spark, sf))


@query("multi_day_panel_build", sql(PANEL, """SELECT series, date AS settle_date, count(*) AS periods,
 count(value) AS observed, round(sum(value),6) AS total FROM panel GROUP BY ALL"""))
def multi_day(spark, sf):
    from ..functions.clock import local_date
    p = P.build_observed_panel(records(spark, sf), CALENDAR, days=coverage(spark, sf))
    return p.groupBy("series", local_date("ts").alias("settle_date")).agg(
        F.count("*").alias("periods"), F.count("value").alias("observed"), F.round(F.sum("value"), 6).alias("total"))


@query("days_without_records", sql(RECORDS, """SELECT d AS settle_date FROM (
 SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS d)
WHERE d NOT IN (SELECT settle_date FROM records)"""))
def no_records(spark, sf):
    from ..functions.clock import SettlementCalendar
    return P.missing_days(records(spark, sf), SettlementCalendar("2024-01-01", "2024-02-10"))


@query("complete_case_exclusions", sql(PANEL, """SELECT series, count(*) FILTER (value IS NULL) AS missing_periods,
 coalesce(stddev_samp(value),0) <= 1e-12 AS constant_profile FROM panel GROUP BY 1
HAVING count(*) FILTER (value IS NULL) > 0 OR coalesce(stddev_samp(value),0) <= 1e-12"""))
def exclusions(spark, sf):
    return P.excluded_series(panel(spark, sf))


@query("complete_case_panel", sql(PANEL, """, dayp AS (SELECT *, count(*) FILTER (value IS NULL) OVER (PARTITION BY series, date) AS gaps,
 stddev_samp(value) OVER (PARTITION BY series, date) AS sd FROM panel)
SELECT series || '_' || date AS series, count(*) AS n, round(sum(value),6) AS total FROM dayp
WHERE gaps = 0 AND sd > 1e-12 GROUP BY 1"""))
def complete_case(spark, sf):
    from ..functions.clock import local_date
    p = panel(spark, sf).withColumn("series", F.concat_ws("_", "series", local_date("ts").cast("string")))
    return P.complete_series(p).groupBy("series").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("season_reindex", sql(PANEL, """, week AS (SELECT * FROM resolved WHERE settle_date BETWEEN DATE '2024-01-07' AND DATE '2024-01-15')
SELECT ids.series, count(*) AS periods, count(w.volume) AS observed FROM (SELECT DISTINCT series FROM panel) ids
CROSS JOIN range(288, 720) t(i) LEFT JOIN week w ON w.series = ids.series AND w.pos = t.i GROUP BY 1"""))
def season_reindex(spark, sf):
    r = records(spark, sf)
    cal = P.season_calendar("2024-01-08", "2024-01-14")
    week = SR.by_settlement_date(r, cal.start, cal.end)
    p = P.build_panel(week, cal, "signed_net", ids=P.series_union(r))
    return p.groupBy("series").agg(F.count("*").alias("periods"), F.count("value").alias("observed"))


@query("combine_distinct_records", sql(RECORDS, """SELECT DISTINCT series, settle_date, period, volume FROM records"""))
def combine(spark, sf):
    r = records(spark, sf).select("series", "settle_date", "period", "volume")
    return P.combine_distinct([r.where("period <= 30"), r.where("period > 20")])


@query("day_profiles", sql(RESOLVED, """, days AS (SELECT series, settle_date, list(volume ORDER BY period)[1:48] AS v,
  count(*) OVER (PARTITION BY series) AS n_days FROM resolved GROUP BY 1, 2)
SELECT series, settle_date, CAST(len(p) AS BIGINT) AS width, round(list_sum(p),6) AS total, round(p[48],6) AS last_value FROM (
 SELECT series, settle_date, list_concat(v, list_transform(range(0, 48-len(v)), lambda x: v[-1])) AS p FROM days WHERE n_days >= 20)"""))
def profiles(spark, sf):
    p = P.day_profiles(R.resolve_revisions(R.sign_volumes(records(spark, sf))), 20)
    return p.select("series", "settle_date", F.size("profile").cast("long").alias("width"),
                    F.round(F.aggregate("profile", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
                    F.round(F.element_at("profile", 48), 6).alias("last_value"))


@query("normalise_by_max", sql(PANEL, """SELECT series, pos, round(CASE WHEN max(value) OVER (PARTITION BY series) = 0 THEN 0
 ELSE value / max(value) OVER (PARTITION BY series) END, 6) AS scaled FROM panel"""))
def normalised(spark, sf):
    return P.normalise_by_max(panel(spark, sf)).select("series", "pos", F.round("scaled", 6).alias("scaled"))


@query("observed_only_source", sql(PANEL, """SELECT series, pos, round(CASE WHEN source LIKE 'observed%' THEN coalesce(value, 0) END,6) AS value FROM panel"""))
def observed_source(spark, sf):
    filled = panel(spark, sf).withColumn("value", F.coalesce("value", F.lit(0.0)))
    return S.observed_only(filled).select("series", "pos", F.round("value", 6).alias("value"))


@query("panel_contract", sql(PANEL, """, s AS (SELECT series, count(*) AS n, max(pos) - min(pos) + 1 - count(*) AS absent FROM panel WHERE source <> 'missing' GROUP BY 1)
SELECT count(*) AS n_series, CAST(0 AS BIGINT) AS null_ids, CAST(0 AS BIGINT) AS duplicate_slots, CAST(sum(absent) AS BIGINT) AS absent_slots,
 CAST(0 AS BIGINT) AS unaligned, CAST(0 AS BIGINT) AS infinite, max(n)-min(n) AS ragged_slots FROM s"""))
def contract(spark, sf):
    return S.contract_report(panel(spark, sf).where(F.col("source") != "missing"))


@query("screening_input_summary", sql(PANEL, """, m AS (SELECT *, value IS NULL AS miss FROM panel),
runs AS (SELECT series, pos - row_number() OVER (PARTITION BY series ORDER BY pos) AS isl FROM m WHERE miss),
longest AS (SELECT series, max(n) AS longest FROM (SELECT series, isl, count(*) AS n FROM runs GROUP BY 1,2) GROUP BY 1)
SELECT m.series, count(value) AS observed_periods, count(*) FILTER (miss) AS missing_before,
 coalesce(max(longest),0) AS longest_run, count(*) FILTER (source='observed_import') AS import_periods,
 count(*) FILTER (source='observed_export') AS export_periods FROM m LEFT JOIN longest USING (series) GROUP BY 1"""))
def flagship(spark, sf):
    """Records to panel to gap summary: one row per series."""
    from ..operators.gaps import gate
    g = gate(panel(spark, sf))
    return g.groupBy("series").agg(
        F.count("value").alias("observed_periods"), F.count_if("_null").alias("missing_before"),
        F.max("longest_run").cast("long").alias("longest_run"),
        F.count_if(F.col("source") == "observed_import").alias("import_periods"),
        F.count_if(F.col("source") == "observed_export").alias("export_periods"))
