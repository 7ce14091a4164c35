"""Gridded temperature to regions: weights, coverage, means, half-hours, id matching.

Geometry is reduced to an equal-area plane (Lambert cylindrical): x = R * lon,
y = R * sin(lat). Grid cells stay rectangles there, so the cells a region can
touch follow from arithmetic and the range join becomes an equi-join on cell
indexes.
"""
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checks import ContractError, guard

# Earth radius in metres, Kelvin offset.
EARTH_RADIUS, KELVIN = 6371007.2, 273.15


def plane_x(lon) -> Column:
    return F.radians(lon) * EARTH_RADIUS


def plane_y(lat) -> Column:
    return F.sin(F.radians(lat)) * EARTH_RADIUS


def expand_aliases(regions: DataFrame, label="label") -> DataFrame:
    """A composite label ``A|B`` also answers to each member; sources are concatenated."""
    trimmed = F.trim(F.col(label))
    names = F.array_distinct(F.concat(F.array(trimmed), F.transform(F.split(trimmed, "\\|"), lambda x: F.trim(x))))
    rows = regions.select(F.explode(names).alias("region"), trimmed.alias("source"), *[c for c in regions.columns if c != label])
    return rows


def alias_sources(regions: DataFrame, label="label") -> DataFrame:
    """One row per id with the labels it came from."""
    return expand_aliases(regions.select(label), label).distinct().groupBy("region").agg(
        F.concat_ws(";", F.sort_array(F.collect_set("source"))).alias("source_regions"))


def _edge_area(ax, ay, bx, by, x0, x1, y0, y1) -> Column:
    """Signed area between the rectangle's lower side and the part of an edge over it, the edge held within the rectangle.

    Added up over a closed ring these are the area of the ring inside the rectangle.
    """
    left, right = (F.least(F.greatest(x, x0), x1) for x in (ax, bx))
    slope = F.try_divide(by - ay, bx - ax)
    u, v = (ay + slope * (left - ax) - y0, ay + slope * (right - ax) - y0)
    height, low, high = y1 - y0, F.least(u, v), F.greatest(u, v)
    inner_low, inner_high = (F.least(F.greatest(e, F.lit(0.0)), height) for e in (low, high))
    rise = F.nullif(high - low, F.lit(0.0))
    mean = F.coalesce((inner_high - inner_low) / rise * (inner_low + inner_high) / 2
                      + F.greatest(high - F.greatest(low, height), F.lit(0.0)) / rise * height, inner_low)
    return F.when(left != right, (right - left) * mean).otherwise(0.0)


def _candidates(regions, cells, grid):
    """Region x cell pairs whose boxes touch, by index arithmetic and one equi-join."""
    lat0, lon0, dlat, dlon = grid
    ix = lambda lon: F.floor((lon - (lon0 - dlon / 2)) / dlon).cast("int")
    iy = lambda lat: F.floor((lat - (lat0 - dlat / 2)) / dlat).cast("int")
    spread = regions.withColumn("ix", F.explode(F.sequence(ix(F.col("lon_min")), ix(F.col("lon_max"))))).withColumn(
        "iy", F.explode(F.sequence(iy(F.col("lat_min")), iy(F.col("lat_max")))))
    placed = cells.select("cell", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).withColumns(
        {"ix": ix(F.col("_lon")), "iy": iy(F.col("_lat"))})
    pairs = spread.join(placed, ["ix", "iy"])
    return pairs.withColumns({
        "_x0": plane_x(F.col("_lon") - dlon / 2), "_x1": plane_x(F.col("_lon") + dlon / 2),
        "_y0": plane_y(F.col("_lat") - dlat / 2), "_y1": plane_y(F.col("_lat") + dlat / 2)})


def box_weights(regions: DataFrame, cells: DataFrame, grid) -> DataFrame:
    """Overlap areas of box regions (lat/lon limits) and valid cells.

    ``grid`` is (first latitude, first longitude, latitude step, longitude step).
    Sea cells are simply absent from ``cells``; nothing replaces them.
    """
    p = _candidates(regions, cells, grid)
    width = F.least(F.col("_x1"), plane_x(F.col("lon_max"))) - F.greatest(F.col("_x0"), plane_x(F.col("lon_min")))
    height = F.least(F.col("_y1"), plane_y(F.col("lat_max"))) - F.greatest(F.col("_y0"), plane_y(F.col("lat_min")))
    area = F.when((width > 0) & (height > 0), width * height)
    return p.select("region", "cell", area.alias("area")).where("area > 0")


def _edges(regions: DataFrame) -> DataFrame:
    """One row per edge of every ring (region, end points as latitude, x and y); the last point is joined to the first."""
    n = F.size("lats")
    ends = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.get("lats", i).alias("a_lat"), F.get("lons", i).alias("a_lon"),
        F.get("lats", (i + 1) % n).alias("b_lat"), F.get("lons", (i + 1) % n).alias("b_lon")))
    edges = regions.where(n > 2).select("region", F.explode(ends).alias("e")).select("region", "e.*").where("a_lat <> b_lat")
    return edges.withColumns({"ax": plane_x("a_lon"), "ay": plane_y("a_lat"), "bx": plane_x("b_lon"), "by": plane_y("b_lat")})


def polygon_weights(regions: DataFrame, cells: DataFrame, grid) -> DataFrame:
    """Overlap areas of polygons (``lats``, ``lons`` arrays) and valid cells.

    A region may have several rows: parts, and holes whose points run the other way round. Each edge is dealt to the grid
    rows it passes and to the cells it crosses there; in such a cell it leaves the signed area between the cell's west
    side and itself, and all cells west of them take its height in that row times their width. Those heights are summed
    from the east along a row, so an interior cell costs one row of a run and no ring meets a cell it does not cross: the
    work is edges, crossed cells and covered cells. A row of the grid bounds the window.
    """
    lat0, lon0, dlat, dlon = grid
    south, west, width = lat0 - dlat / 2, lon0 - dlon / 2, math.radians(dlon) * EARTH_RADIUS
    row = lambda lat: F.floor((lat - south) / dlat).cast("int")
    column = lambda x: F.floor((x / width) - west / dlon).cast("int")
    side = lambda i: (i + west / dlon) * width
    low, high = F.least("a_lat", "b_lat"), F.greatest("a_lat", "b_lat")
    banded = _edges(regions).withColumn("iy", F.explode(F.sequence(row(low), row(high))))
    banded = banded.withColumns({"y0": plane_y(south + F.col("iy") * dlat), "y1": plane_y(south + (F.col("iy") + 1) * dlat)})
    held = lambda y: F.least(F.greatest(F.col(y), F.col("y0")), F.col("y1"))
    at = lambda y: F.col("ax") + (F.col("bx") - F.col("ax")) * ((held(y) - F.col("ay")) / (F.col("by") - F.col("ay")))
    banded = banded.withColumns({"climb": held("by") - held("ay"), "first": column(F.least(at("ay"), at("by"))),
                                 "last": column(F.greatest(at("ay"), at("by")))}).where("climb <> 0")
    crossed = banded.withColumn("ix", F.explode(F.sequence("first", "last")))
    part = _edge_area(*map(F.col, ("ay", "ax", "by", "bx", "y0", "y1")), side(F.col("ix")), side(F.col("ix") + 1))
    events = crossed.groupBy("region", "iy", "ix").agg(
        F.sum(part).alias("part"), F.sum(F.when(F.col("ix") == F.col("first"), F.col("climb")).otherwise(0.0)).alias("climb"),
        F.max(F.col("y1") - F.col("y0")).alias("height"))
    along = Window.partitionBy("region", "iy").orderBy(F.col("ix").desc())
    east = F.coalesce(F.sum("climb").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    swept = events.withColumns({"east": east, "next": F.lead("ix").over(along)})
    inner = F.col("east") + F.col("climb")  # what lies between this crossed cell and the next one to the west
    run = F.when((F.abs(inner) > 1e-9 * F.col("height")) & (F.col("next") < F.col("ix") - 1), F.sequence(F.col("next") + 1, F.col("ix") - 1))
    here = F.struct("ix", F.abs(F.col("part") + F.col("east") * width).alias("area"))
    filled = F.transform(F.coalesce(run, F.array().cast("array<int>")), lambda i: F.struct(i.alias("ix"), F.abs(inner * width).alias("area")))
    covered = swept.select("region", "iy", "height", F.explode(F.concat(F.array(here), filled)).alias("c")).select(
        "region", "iy", F.col("c.ix").alias("ix"), F.col("c.area").alias("area"), "height")
    placed = cells.select("cell", row(F.col("lat")).alias("iy"), column(plane_x("lon")).alias("ix"))
    # what the sums leave by rounding is no overlap
    found = covered.where(F.col("area") > 1e-9 * width * F.col("height")).join(placed, ["ix", "iy"])
    return found.select("region", "cell", "area")


def box_area() -> Column:
    return (plane_x(F.col("lon_max")) - plane_x(F.col("lon_min"))) * (plane_y(F.col("lat_max")) - plane_y(F.col("lat_min")))


def coverage_table(weights: DataFrame, region_areas: DataFrame) -> DataFrame:
    """Per region: area, valid overlap, covered fraction, cell count and method."""
    got = weights.groupBy("region").agg(F.sum("area").alias("overlap"), F.count("*").alias("cells"))
    out = region_areas.join(got, "region", "left").select(
        "region", "region_area", F.coalesce("overlap", F.lit(0.0)).alias("valid_grid_overlap"),
        F.coalesce("cells", F.lit(0)).cast("long").alias("grid_cells"))
    return out.withColumns({
        "coverage_fraction": F.try_divide("valid_grid_overlap", "region_area"),
        "spatial_method": F.when(F.col("grid_cells") > 0, "area_weighted_land_grid").otherwise("no_land_grid_overlap")})


def to_celsius(grid: DataFrame) -> DataFrame:
    return grid.withColumn("temperature_c", F.col("temp_k") - KELVIN).drop("temp_k")


def regional_mean(grid: DataFrame, weights: DataFrame, value="temperature_c") -> DataFrame:
    """Weighted mean per timestamp, weights renormalised over the cells with a value.

    Partial sums per (ts, region) combine on the map side, so a cell or region with
    many rows does not gather in one task; the weight table joins by size.
    """
    finite = F.col(value).isNotNull() & ~F.isnan(value)
    joined = grid.join(weights, "cell").where("area > 0")
    w = F.when(finite, F.col("area"))
    return joined.groupBy("ts", "region").agg(
        F.try_divide(F.sum(w * F.col(value)), F.nullif(F.sum(w), F.lit(0.0))).alias(value))


def hour_axis(hourly: DataFrame, by=()) -> DataFrame:
    """Every hour from the first to the last one present, of all rows or of each ``by``."""
    span = hourly.groupBy(*by).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return span.select(*by, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("ts"))


def missing_hours(hourly: DataFrame, by=()) -> DataFrame:
    """Hours of the axis without a row; with ``by``, the holes inside each cell's or source's own span."""
    keys = [*by, "ts"]
    return hour_axis(hourly, by).join(hourly.select(*keys).distinct(), keys, "left_anti")


def half_hourly(hourly: DataFrame, value="temperature_c") -> DataFrame:
    """Exact hours kept, :30 = mean of both neighbours; nothing bridged or extrapolated."""
    clean = hourly.withColumn("ts", guard(F.col("ts"), (F.unix_micros("ts") % 3_600_000_000) != 0,
                                          "Exact hourly timestamps required", "timestamp"))
    span = clean.agg(F.struct(F.min("ts").alias("first"), F.max("ts").alias("last"))).scalar()
    hour, order = F.expr("INTERVAL 1 HOUR"), Window.partitionBy("region").orderBy("ts")
    rows = clean.select("region", "ts", value).withColumns({
        "_span": span, "_to": F.lead("ts").over(order), "_after": F.lead(value).over(order), "_start": F.lag("ts").over(order).isNull()})
    # each reading covers the hours up to the next one, the first also those before it
    hours = F.sequence(F.when(F.col("_start"), F.col("_span.first")).otherwise(F.col("ts")),
                       F.greatest(F.coalesce(F.col("_to") - hour, F.col("_span.last")), F.col("ts")), hour)
    rows = rows.withColumn("_hour", F.explode(hours))
    own = F.when(F.col("_hour") == F.col("ts"), F.col(value))
    middle = F.when(F.col("_to") == F.col("_hour") + hour, (own + F.col("_after")) / 2)
    pair = F.array(F.struct(F.lit(0).alias("m"), own.alias("v")), F.struct(F.lit(30).alias("m"), middle.alias("v")))
    rows = rows.withColumn("h", F.explode(pair))
    return rows.select("region", F.timestamp_seconds(F.unix_seconds("_hour") + F.col("h.m") * 60).alias("ts"), F.col("h.v").alias(value))


def with_method(temperature: DataFrame, value="temperature_c") -> DataFrame:
    kind = F.when(F.col(value).isNull(), "missing").when(F.minute("ts") == 0, "hourly_reanalysis").otherwise("linear_midpoint")
    return temperature.withColumn("temporal_method", kind)


def temperature_table(grid: DataFrame, weights: DataFrame) -> DataFrame:
    """Grid to the published half-hour table (float values, with the temporal method)."""
    hourly = regional_mean(to_celsius(grid), weights)
    return with_method(half_hourly(hourly)).withColumn("temperature_c", F.col("temperature_c").cast("float"))


def match_ids(demand_ids: DataFrame, regions: DataFrame, coverage: DataFrame) -> DataFrame:
    """Which demand series have a boundary, and which have a usable temperature."""
    known = regions.select(F.col("region").alias("series")).distinct().withColumn("_b", F.lit(True))
    usable = coverage.where("grid_cells > 0").select(F.col("region").alias("series")).distinct().withColumn("_t", F.lit(True))
    out = demand_ids.select("series").distinct().join(known, "series", "left").join(usable, "series", "left")
    return out.select("series", F.coalesce("_b", F.lit(False)).alias("boundary_match"),
                      F.coalesce("_t", F.lit(False)).alias("has_temperature"))


def grid_violations(grid: DataFrame) -> DataFrame:
    """Counts of wrong units, repeated (ts, cell) readings and cells not valid in every source.

    A cell is valid in a source when it has any reading there; all sources must
    share one valid set, so each cell's source count must equal the total.
    """
    rows = grid.groupBy("source", "cell", "ts").agg(F.count("*").alias("n"), F.count_if(F.col("unit") != "K").alias("bad"),
                                                    F.count("temp_k").alias("v"))
    repeated = rows.groupBy("cell", "ts").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).agg(
        F.count_if(F.col("n") > 1).alias("overlapping_readings"), F.sum("bad").alias("not_kelvin"))
    valid = rows.where("v > 0").select("source", "cell").distinct()
    total = valid.select("source").distinct().agg(F.count("*")).scalar()
    odd = valid.groupBy("cell").agg(F.count("*").alias("n")).withColumn("_t", total).agg(
        F.count_if(F.col("n") != F.col("_t")).alias("cells_not_in_every_source"))
    return repeated.withColumn("cells_not_in_every_source", odd.scalar())


def check_grid(grid: DataFrame) -> DataFrame:
    row = grid_violations(grid).first().asDict()
    if any(row.values()):
        raise ContractError(f"Grid contract broken: {row}")
    return grid


def grid_inventory(grid: DataFrame) -> DataFrame:
    """Hours and time span of every source."""
    return grid.groupBy("source", "ts").agg(F.count("*").alias("n")).groupBy("source").agg(
        F.count("*").alias("hours"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.sum("n").alias("readings"))
