"""The engine's inputs, derived from the given tables (Spark side and SQL side)."""
from pyspark.sql import DataFrame, functions as F

from ..functions.clock import SettlementCalendar, local_date, settlement_period
from ..operators import panel as P
from ..session import configure

CALENDAR = SettlementCalendar("2024-01-01", "2024-01-30")
N = CALENDAR.n_slots


def registrar():
    """Query and SQL dictionaries of one module, and the decorator that fills them."""
    found, texts = {}, {}

    def query(name, text=None):
        def add(fn):
            found[name] = fn
            if text:
                texts[name] = text
            return fn
        return add
    return found, texts, query


def table(spark, sf, name, *columns) -> DataFrame:
    df = configure(spark).read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def events(spark, sf) -> DataFrame:
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def records(spark, sf) -> DataFrame:
    """Every event reads one meter twice: by user group and by event type, in one scan."""
    e = events(spark, sf)
    names = F.array(F.concat(F.lit("U"), (F.col("user_id") % 3).cast("string")),
                    F.concat(F.lit("T_"), F.col("event_type")))
    return e.select(
        F.explode(names).alias("series"), local_date("ts").alias("settle_date"),
        settlement_period("ts").alias("period"), F.col("value").alias("volume"),
        F.when(F.col("event_type") == "error", "E").otherwise("I").alias("flow"),
        local_date("ts").alias("rev_agg"), F.col("ts").alias("rev_flow"), F.col("event_id").alias("rev_run"),
        (F.col("event_id") % 10 == 0).alias("estimated"))


def panel(spark, sf) -> DataFrame:
    return P.build_panel(records(spark, sf), CALENDAR)


def zero_panel(spark, sf) -> DataFrame:
    """The panel with gaps read as 0, for operators that need complete stretches."""
    return panel(spark, sf).withColumn("value", F.coalesce("value", F.lit(0.0)))


def r6(*names):
    return {n: F.round(F.col(n), 6) for n in names}


def long(*names):
    return {n: F.col(n).cast("long") for n in names}


RECORDS = """records AS (
 SELECT s.series, CAST(ts AS DATE) AS settle_date,
  CAST(hour(ts)*2 + floor(minute(ts)/30) + 1 AS INTEGER) AS period, value AS volume,
  CASE WHEN event_type='error' THEN 'E' ELSE 'I' END AS flow,
  CAST(ts AS DATE) AS rev_agg, ts AS rev_flow, event_id AS rev_run, event_id % 10 = 0 AS estimated
 FROM events, LATERAL (SELECT unnest(['U' || (user_id % 3), 'T_' || event_type]) AS series) s)"""
RESOLVED = RECORDS + """,
resolved AS (
 SELECT series, settle_date, period, CASE WHEN flow='E' THEN -volume ELSE volume END AS volume, flow, estimated,
  n_rows, CAST(date_diff('day', DATE '2024-01-01', settle_date)*48 + period - 1 AS INTEGER) AS pos
 FROM (SELECT *, row_number() OVER (PARTITION BY series, settle_date, period
        ORDER BY rev_agg DESC, rev_flow DESC, rev_run DESC) AS rn,
        count(*) OVER (PARTITION BY series, settle_date, period) AS n_rows FROM records) WHERE rn = 1)"""
PANEL = RESOLVED + """,
calendar AS (SELECT CAST(i AS INTEGER) AS pos, TIMESTAMP '2024-01-01' + INTERVAL 30 MINUTE * i AS ts,
  CAST(i % 48 AS INTEGER) AS slot, CAST(TIMESTAMP '2024-01-01' + INTERVAL 30 MINUTE * i AS DATE) AS date,
  CASE WHEN isodow(TIMESTAMP '2024-01-01' + INTERVAL 30 MINUTE * i) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type
  FROM range(0, 1440) t(i)),
panel AS (
 SELECT ids.series, c.pos, c.ts, c.slot, c.date, c.day_type, r.volume AS value, r.estimated,
  CASE WHEN r.volume IS NULL THEN 'missing' WHEN r.flow='E' THEN 'observed_export' ELSE 'observed_import' END AS source
 FROM (SELECT DISTINCT series FROM resolved) ids CROSS JOIN calendar c
 LEFT JOIN resolved r ON r.series = ids.series AND r.pos = c.pos)"""
ZPANEL = PANEL + """,
zpanel AS (SELECT series, pos, ts, slot, date, day_type, coalesce(value, 0.0) AS value FROM panel)"""


def sql(ctes: str, body: str) -> str:
    """``ctes`` plus ``body``; a body that starts with a comma adds further CTEs."""
    return f"WITH {ctes}{body.strip() if body.strip().startswith(',') else chr(10) + body}"
