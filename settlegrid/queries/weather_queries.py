"""Temperature queries: grid cells are users, regions are user groups."""
from pyspark.sql import functions as F

from ..operators import weather as T
from .inputs import events, panel, registrar, sql, table

Q, SQL, query = registrar()

GRID = """events_h AS (SELECT date_trunc('hour', ts) AS ts, user_id AS cell, avg(value) + 273.15 AS temp_k FROM events GROUP BY 1, 2),
weights AS (SELECT DISTINCT 'R' || (user_id % 3) AS region, user_id AS cell, CAST(1 + user_id % 5 AS DOUBLE) AS area FROM events),
hourly AS (SELECT ts, region, sum(area*(temp_k-273.15))/sum(area) AS temperature_c FROM events_h JOIN weights USING (cell) GROUP BY 1, 2)"""
HALF = GRID + """,
axis AS (SELECT region, unnest(generate_series((SELECT min(ts) FROM hourly), (SELECT max(ts) FROM hourly), INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT region FROM hourly)),
half AS (SELECT a.region, a.ts, h.temperature_c FROM axis a LEFT JOIN hourly h USING (region, ts)
 UNION ALL SELECT a.region, a.ts + INTERVAL 30 MINUTE, (h.temperature_c + n.temperature_c)/2 FROM axis a LEFT JOIN hourly h USING (region, ts)
 LEFT JOIN hourly n ON n.region = a.region AND n.ts = a.ts + INTERVAL 1 HOUR)"""


def grid(spark, sf):
    e = events(spark, sf)
    return e.groupBy(F.date_trunc("hour", "ts").alias("ts"), F.col("user_id").alias("cell")).agg(
        (F.avg("value") + T.KELVIN).alias("temp_k"))


def weights(spark, sf):
    u = events(spark, sf).select(F.col("user_id").alias("cell")).distinct()
    return u.select(F.concat(F.lit("R"), (F.col("cell") % 3).cast("string")).alias("region"), "cell",
                    (1 + F.col("cell") % 5).cast("double").alias("area"))


def hourly(spark, sf):
    return T.regional_mean(T.to_celsius(grid(spark, sf)), weights(spark, sf))


def clock(name="ts"):
    return F.date_format(name, "yyyy-MM-dd HH:mm").alias("ts")


@query("kelvin_to_celsius", sql(GRID, "SELECT cell, strftime(ts, '%Y-%m-%d %H:%M') AS ts, round(temp_k-273.15,6) AS temperature_c FROM events_h"))
def celsius(spark, sf):
    return T.to_celsius(grid(spark, sf)).select("cell", clock(), F.round("temperature_c", 6).alias("temperature_c"))


@query("region_weighted_mean", sql(GRID, "SELECT region, strftime(ts, '%Y-%m-%d %H:%M') AS ts, round(temperature_c+1e-10,6) AS temperature_c FROM hourly"))
def weighted_mean(spark, sf):
    return hourly(spark, sf).select("region", clock(), F.round(F.col("temperature_c") + 1e-10, 6).alias("temperature_c"))


@query("hour_axis", sql(GRID, "SELECT strftime(unnest(generate_series((SELECT min(ts) FROM hourly), (SELECT max(ts) FROM hourly), INTERVAL 1 HOUR)), '%Y-%m-%d %H:%M') AS ts"))
def axis(spark, sf):
    return T.hour_axis(hourly(spark, sf)).select(clock())


@query("missing_grid_hours", """WITH v AS (SELECT DISTINCT user_id % 50 AS cell, date_trunc('hour', ts) AS ts FROM events),
a AS (SELECT cell, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM v GROUP BY cell)
SELECT CAST(cell AS BIGINT) AS cell, strftime(ts, '%Y-%m-%d %H:%M') AS ts FROM a ANTI JOIN v USING (cell, ts)""")
def gaps(spark, sf):
    """Holes of each of fifty cells that the users' events fill."""
    e = events(spark, sf).select((F.col("user_id") % 50).cast("long").alias("cell"), F.date_trunc("hour", "ts").alias("ts"))
    return T.missing_hours(e, ("cell",)).select("cell", clock())


@query("half_hour_temperature", sql(HALF, "SELECT region, strftime(ts, '%Y-%m-%d %H:%M') AS ts, round(temperature_c+1e-10,6) AS temperature_c FROM half"))
def half(spark, sf):
    return T.half_hourly(hourly(spark, sf)).select("region", clock(), F.round(F.col("temperature_c") + 1e-10, 6).alias("temperature_c"))


@query("temperature_methods", sql(HALF, """SELECT region, CASE WHEN temperature_c IS NULL THEN 'missing' WHEN minute(ts) = 0 THEN 'hourly_reanalysis' ELSE 'linear_midpoint' END AS temporal_method,
 count(*) AS n FROM half GROUP BY 1, 2"""))
def methods(spark, sf):
    return T.with_method(T.half_hourly(hourly(spark, sf))).groupBy("region", "temporal_method").agg(F.count("*").alias("n"))


@query("grid_contract", """WITH rows AS (SELECT event_type AS source, user_id AS cell, date_trunc('hour', ts) AS ts, CASE WHEN event_type = 'error' THEN 'C' ELSE 'K' END AS unit, count(*) AS n FROM events GROUP BY 1,2,3),
rep AS (SELECT cell, ts, sum(n) AS n FROM rows GROUP BY 1, 2), val AS (SELECT DISTINCT source, cell FROM rows),
odd AS (SELECT cell FROM val GROUP BY 1 HAVING count(*) <> (SELECT count(DISTINCT source) FROM val))
SELECT (SELECT count(*) FROM rep WHERE n > 1) AS overlapping_readings, CAST((SELECT sum(n) FROM rows WHERE unit <> 'K') AS BIGINT) AS not_kelvin, (SELECT count(*) FROM odd) AS cells_not_in_every_source""")
def contract(spark, sf):
    return T.grid_violations(sources(spark, sf))


def sources(spark, sf):
    return events(spark, sf).select(
        F.col("event_type").alias("source"), F.col("user_id").alias("cell"), F.date_trunc("hour", "ts").alias("ts"),
        (F.col("value") + T.KELVIN).alias("temp_k"), F.when(F.col("event_type") == "error", "C").otherwise("K").alias("unit"))


@query("grid_source_inventory", """SELECT event_type AS source, count(DISTINCT date_trunc('hour', ts)) AS hours, strftime(min(date_trunc('hour', ts)), '%Y-%m-%d %H:%M') AS "start",
 strftime(max(date_trunc('hour', ts)), '%Y-%m-%d %H:%M') AS "end", count(*) AS readings FROM events GROUP BY 1""")
def inventory(spark, sf):
    i = T.grid_inventory(sources(spark, sf))
    return i.select("source", "hours", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"),
                    F.date_format("end", "yyyy-MM-dd HH:mm").alias("end"), "readings")


LABELS = """names AS (SELECT n_name || '|' || r_name || ' | ' || n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey),
parts AS (SELECT label AS source, unnest(list_concat([label], list_transform(string_split(label, '|'), lambda x: trim(x)))) AS region FROM names)"""


@query("region_alias_expansion", sql(LABELS, "SELECT region, string_agg(DISTINCT source, ';' ORDER BY source) AS source_regions FROM parts GROUP BY 1"))
def aliases(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return T.alias_sources(n.select(F.concat("n_name", F.lit("|"), "r_name", F.lit(" | "), "n_name").alias("label")))


BOX = """cells AS (SELECT DISTINCT user_id AS cell, 50 + (user_id // 15)*0.5::DOUBLE AS lat, -5 + (user_id % 15)*0.5::DOUBLE AS lon FROM events),
boxes AS (SELECT n_name AS region, 50 + n_nationkey*0.17::DOUBLE AS lat_min, 50.9 + n_nationkey*0.17::DOUBLE AS lat_max, -5 + n_nationkey*0.31::DOUBLE AS lon_min, -3.9 + n_nationkey*0.31::DOUBLE AS lon_max FROM nation),
overlap AS (SELECT region, cell, 6371007.2*6371007.2*(radians(least(lon+0.25, lon_max)) - radians(greatest(lon-0.25, lon_min)))*(sin(radians(least(lat+0.25, lat_max))) - sin(radians(greatest(lat-0.25, lat_min)))) AS area
 FROM cells JOIN boxes ON least(lon+0.25, lon_max) > greatest(lon-0.25, lon_min) AND least(lat+0.25, lat_max) > greatest(lat-0.25, lat_min))"""
GRID_SPEC = (50.0, -5.0, 0.5, 0.5)


def cells(spark, sf):
    u = events(spark, sf).select("user_id").distinct()
    return u.select(F.col("user_id").alias("cell"), (50 + F.floor(F.col("user_id") / 15) * 0.5).alias("lat"),
                    (-5 + (F.col("user_id") % 15) * 0.5).alias("lon"))


def boxes(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(F.col("n_name").alias("region"), (50 + k * 0.17).alias("lat_min"), (50.9 + k * 0.17).alias("lat_max"),
                                             (-5 + k * 0.31).alias("lon_min"), (-3.9 + k * 0.31).alias("lon_max"))


@query("grid_region_weights", sql(BOX, "SELECT region, cell, round(area/1000000,4) AS area_km2 FROM overlap"))
def box_weights(spark, sf):
    w = T.box_weights(boxes(spark, sf), cells(spark, sf), GRID_SPEC)
    return w.select("region", "cell", F.round(F.col("area") / 1000000, 4).alias("area_km2"))


@query("grid_polygon_weights", sql(BOX, """, tri AS (SELECT region, cell, 6371007.2*radians(greatest(lon-0.25, lon_min)) AS a, 6371007.2*radians(least(lon+0.25, lon_max)) AS b,
 6371007.2*sin(radians(greatest(lat-0.25, lat_min))) AS low, 6371007.2*sin(radians(lat+0.25)) AS high, 6371007.2*radians(lon_min) AS x0, 6371007.2*radians(lon_max) AS x1,
 6371007.2*sin(radians(lat_min)) AS y0, 6371007.2*sin(radians(lat_max)) AS y1
 FROM cells JOIN boxes ON least(lon+0.25, lon_max) > greatest(lon-0.25, lon_min) AND least(lat+0.25, lat_max) > greatest(lat-0.25, lat_min)),
cut AS (SELECT *, (y1-y0)/(x1-x0) AS fall, least(greatest(x0 + (y1-high)*(x1-x0)/(y1-y0), a), b) AS p, least(greatest(x0 + (y1-low)*(x1-x0)/(y1-y0), a), b) AS q FROM tri),
ar AS (SELECT region, cell, (p-a)*(high-low) + (q-p)*(y1 - fall*((p+q)/2-x0) - low) AS area FROM cut)
SELECT region, cell, round(area/1000000,4) AS area_km2 FROM ar WHERE area > 1"""))
def polygon_weights(spark, sf):
    """Triangles: the halves of the boxes below a falling diagonal."""
    b = boxes(spark, sf).select("region", F.array("lat_min", "lat_min", "lat_max").alias("lats"), F.array("lon_min", "lon_max", "lon_min").alias("lons"))
    w = T.polygon_weights(b, cells(spark, sf), GRID_SPEC).where("area > 1")
    return w.select("region", "cell", F.round(F.col("area") / 1000000, 4).alias("area_km2"))


@query("region_coverage", sql(BOX, """SELECT b.region, round(coalesce(sum(area),0)/(6371007.2*6371007.2*(radians(max(lon_max))-radians(max(lon_min)))*(sin(radians(max(lat_max)))-sin(radians(max(lat_min))))),6) AS coverage_fraction,
 count(cell) AS grid_cells, CASE WHEN count(cell) > 0 THEN 'area_weighted_land_grid' ELSE 'no_land_grid_overlap' END AS spatial_method FROM boxes b LEFT JOIN overlap o USING (region) GROUP BY 1"""))
def coverage(spark, sf):
    b = boxes(spark, sf)
    c = T.coverage_table(T.box_weights(b, cells(spark, sf), GRID_SPEC), b.select("region", T.box_area().alias("region_area")))
    return c.select("region", F.round("coverage_fraction", 6).alias("coverage_fraction"), "grid_cells", "spatial_method")


@query("demand_region_matching", """WITH ids AS (SELECT DISTINCT unnest(['U' || (user_id % 3), 'T_' || event_type]) AS series FROM events),
cov AS (SELECT 'U' || (user_id % 3) AS region, count(DISTINCT user_id) AS n FROM events WHERE user_id % 3 <> 2 GROUP BY 1)
SELECT series, series LIKE 'U%' AS boundary_match, series IN (SELECT region FROM cov WHERE n > 0) AS has_temperature FROM ids""")
def matching(spark, sf):
    u = events(spark, sf).select("user_id", F.concat(F.lit("U"), (F.col("user_id") % 3).cast("string")).alias("region"))
    cover = u.groupBy("region").agg(F.count_distinct(F.when(F.col("user_id") % 3 != 2, F.col("user_id"))).alias("grid_cells"))
    return T.match_ids(panel(spark, sf).select("series"), u.select("region"), cover)
