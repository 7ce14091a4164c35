"""Sources and sinks end to end: tables are written to the shared folder and read back."""
from pyspark.sql import functions as F

from ..functions.clock import SettlementCalendar
from ..operators import gaps as G, panel as P, revisions as R, weather as T
from ..session import durable, scratch
from ..sources import panels as S, records as SR
from .forecast_queries import CASES, cases
from .gap_queries import POLICY, QUALITY
from .inputs import CALENDAR, PANEL, panel, registrar, sql
from .panel_queries import raw_text
from .weather_queries import HALF, grid, weights

Q, SQL, query = registrar()


@query("record_files_to_panel", sql(PANEL, "SELECT series, count(value) AS observed, round(sum(value),6) AS total FROM panel GROUP BY 1"))
def record_files(spark, sf):
    """Two folders of meter files with different column orders, back to the panel.

    The text revision keeps dates only, so the run number decides, as it does for the events.
    """
    raw = raw_text(spark, sf).withColumn("part", F.pmod(F.col("rev_run").cast("long"), F.lit(2)))
    base, names = scratch(spark), SR.COLUMNS
    for part, order in ((0, list(names)), (1, list(reversed(names)))):
        raw.where(F.col("part") == part).select(*[F.col(c).alias(names[c]) for c in order]).write.option("header", True).csv(f"{base}/{part}")
    files = SR.load_records(spark, [f"{base}/0", f"{base}/1"], CALENDAR.start, CALENDAR.end, "signed_net")
    p = P.build_panel(R.parse_records(files), CALENDAR)
    return p.groupBy("series").agg(F.count("value").alias("observed"), F.round(F.sum("value"), 6).alias("total"))


@query("run_tables_sink", sql(QUALITY, """SELECT f.series, count(f.value) AS observed, count(f.filled) AS filled, any_value(q.status) AS status FROM filled f JOIN quality q USING (series) GROUP BY 1"""))
def run_tables(spark, sf):
    filled = G.fill_gaps(panel(spark, sf), POLICY)
    paths = S.write_run({"panel": filled.select("series", "pos", "ts", "value", "filled", "source"),
                         "mask": G.missing_mask(filled), "quality": G.quality(filled)}, scratch(spark))
    q = spark.read.parquet(paths["quality"]).select("series", "status")
    p = spark.read.parquet(paths["panel"]).groupBy("series").agg(F.count("value").alias("observed"), F.count("filled").alias("filled"))
    return p.join(q, "series")


@query("filled_panel_source", sql(QUALITY, "SELECT series, count(value) AS observed FROM filled GROUP BY 1"))
def filled_source(spark, sf):
    """A stored filled panel, read as a forecasting source: fills are blanked out again."""
    filled = G.fill_gaps(panel(spark, sf), POLICY)
    path = S.write_table(filled.select("series", "pos", "ts", F.col("filled").alias("value"), "source"), scratch(spark))
    return S.read_panel(spark, filled_path=path).groupBy("series").agg(F.count("value").alias("observed"))


@query("case_table_sink", sql(CASES, "SELECT model, CAST(origin_pos AS INTEGER) AS origin_pos, count(*) AS n FROM cases WHERE model = 'seasonal_48' AND origin_pos >= 960 GROUP BY 1, 2"))
def case_sink(spark, sf):
    """All origins in one job; reading one model and late origins prunes the folders."""
    path = S.write_cases(cases(spark, sf).withColumn("origin", CALENDAR.ts("origin_pos")), scratch(spark))
    stored = spark.read.parquet(path).where((F.col("model") == "seasonal_48") & (F.col("origin_day") >= F.lit("2024-01-21").cast("date")))
    return stored.groupBy("model", "origin_pos").agg(F.count("*").alias("n"))


@query("case_table_by_origin", sql(CASES, "SELECT model, CAST(origin_pos AS INTEGER) AS origin_pos, count(*) AS n FROM cases GROUP BY 1, 2"))
def case_by_origin(spark, sf):
    """A study cut off after four origins and then run again: only the committed origins are skipped."""
    rows, root = durable(cases(spark, sf)), scratch(spark)
    origins = [r[0] for r in rows.select("origin_pos").distinct().orderBy("origin_pos").collect()]
    of = lambda origin: rows.where(F.col("origin_pos") == origin)
    S.append_origins(spark, root, origins[:4], of, "plan")
    of(origins[4]).limit(3).drop("origin_pos").write.parquet(f"{root}/cases/origin_pos={origins[4]}")  # left behind without an entry
    S.append_origins(spark, root, origins, of, "plan")
    return S.read_origins(spark, root).groupBy("model", "origin_pos").agg(F.count("*").alias("n"))


@query("pruned_record_sources", sql(PANEL, """SELECT series, count(value) AS observed, round(sum(value),6) AS total,
 TRUE AS fewer_files FROM panel WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' GROUP BY 1"""))
def pruned_sources(spark, sf):
    """A folder a week; the stored zone map leaves one of them to be opened for the second week."""
    day = F.datediff(F.to_date("settle_date", "yyyyMMdd"), F.lit("2024-01-05").cast("date"))
    raw = raw_text(spark, sf).withColumn("part", F.floor(day / 7).cast("int"))
    base, names = scratch(spark), SR.COLUMNS
    raw.select("part", *[F.col(c).alias(n) for c, n in names.items()]).write.partitionBy("part").option("header", True).csv(f"{base}/files")
    folders = [f"{base}/files/part={r[0]}" for r in raw.select("part").distinct().collect()]
    zones = spark.read.parquet(S.write_table(SR.zone_map(spark, folders), f"{base}/zones"))
    week = SettlementCalendar("2024-01-05", "2024-01-11")
    files = SR.load_records(spark, None, week.start, week.end, "signed_net", zones)
    held = len(files.inputFiles())
    p = P.build_panel(R.parse_records(files), week)
    return p.groupBy("series").agg(F.count("value").alias("observed"), F.round(F.sum("value"), 6).alias("total")).withColumn(
        "fewer_files", F.lit(held) < zones.agg(F.count("*")).scalar())


@query("monthly_temperature_sink", sql(HALF, """SELECT strftime(ts, '%Y-%m') AS month, region, count(*) AS n, count(temperature_c) AS known FROM half GROUP BY 1, 2"""))
def monthly(spark, sf):
    path = S.write_monthly_temperature(T.temperature_table(grid(spark, sf), weights(spark, sf)), scratch(spark))
    return spark.read.option("inferSchema", False).parquet(path).groupBy(F.col("month").cast("string").alias("month"), "region").agg(
        F.count("*").alias("n"), F.count("temperature_c").alias("known"))
