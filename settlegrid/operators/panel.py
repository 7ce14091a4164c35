"""Dense panel building, provenance and audits."""
from pyspark.sql import DataFrame, Window, functions as F

from ..checks import guard, require_empty
from ..functions.clock import SettlementCalendar, local
from ..functions.windows import over_series, whole
from .revisions import resolve_revisions, sign_volumes

OBSERVED = ["observed", "observed_import", "observed_export"]


def locate(resolved: DataFrame, calendar: SettlementCalendar) -> DataFrame:
    """Add ``pos``; a row outside the calendar is an error."""
    pos = calendar.pos_of_period("settle_date", "period")
    return resolved.withColumn("pos", guard(pos, pos.isNull(), "Record outside the requested calendar", "int"))


def outside_calendar(records: DataFrame, calendar: SettlementCalendar) -> DataFrame:
    return records.where(calendar.pos_of_period("settle_date", "period").isNull())


def missing_days(records: DataFrame, calendar: SettlementCalendar) -> DataFrame:
    """Calendar days without any record (the panel build refuses them)."""
    spark = records.sparkSession
    days = spark.range(calendar.n_days).select(
        F.date_add(F.lit(calendar.start).cast("date"), F.col("id").cast("int")).alias("settle_date"))
    return days.join(records.select("settle_date").distinct(), "settle_date", "left_anti")


def densify(located: DataFrame, calendar: SettlementCalendar, ids: DataFrame | None = None,
            carry=("value", "source")) -> DataFrame:
    """Every series x every calendar slot, gaps as NULL.

    A row explodes over the empty slots that follow it, so densifying needs one
    shuffle by series and neither a cross join nor a join. ``ids`` adds series
    without any record (a marker row before slot 0).
    """
    rows = located.select("series", "pos", *carry)
    if ids is not None:
        markers = ids.select("series").distinct().select(
            "series", F.lit(-1).alias("pos"), *[F.lit(None).cast(dict(located.dtypes)[c]).alias(c) for c in carry])
        rows = rows.unionByName(markers)
    w = over_series(["series"])
    first = F.when(F.lag("pos").over(w).isNull(), 0).otherwise(F.greatest(F.col("pos"), F.lit(0)))
    spread = rows.select("*", first.alias("_from"), F.lead("pos", 1, calendar.n_slots).over(w).alias("_to"))
    spread = spread.where(F.col("_to") > F.col("_from")).select(
        "series", F.col("pos").alias("_at"), *carry,
        F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("pos"))
    here = F.col("pos") == F.col("_at")
    return spread.select("series", "pos", calendar.ts("pos").alias("ts"),
                         *[F.when(here, F.col(c)).alias(c) for c in carry])


def provenance(direction: str):
    kind = (F.when(F.col("flow") == "E", "observed_export").otherwise("observed_import")
            if direction == "signed_net" else F.lit("observed"))
    return F.when(F.col("volume").isNotNull(), kind)


def build_panel(records: DataFrame, calendar: SettlementCalendar, direction="signed_net",
                ids: DataFrame | None = None) -> DataFrame:
    """Typed records to the dense panel (series, pos, ts, value, source, estimated)."""
    signed = sign_volumes(records) if direction == "signed_net" else records
    resolved = locate(resolve_revisions(signed), calendar)
    return panel_from_resolved(resolved, calendar, direction, ids)


def panel_from_resolved(located, calendar, direction="signed_net", ids=None):
    cells = located.select("series", "pos", F.col("volume").alias("value"),
                           provenance(direction).alias("source"), "estimated")
    dense = densify(cells, calendar, ids, carry=("value", "source", "estimated"))
    return dense.withColumn("source", F.coalesce("source", F.lit("missing")))


def build_observed_panel(records, calendar, days: DataFrame | None = None) -> DataFrame:
    """Multi-year build in one job: no per-day staging, revisions resolved per key.

    A calendar day without any record is refused. ``days`` names the days there are (settle_date), such as the stored
    inventory of the sources; without it the records are scanned for them.
    """
    require_empty(missing_days(records if days is None else days, calendar), "No records at all for settlement day")
    return build_panel(records, calendar, "signed_net")


def panel_audit(records: DataFrame, calendar: SettlementCalendar, direction="signed_net") -> DataFrame:
    """Counts of one panel build from the resolved rows alone: no dense panel is made."""
    signed = sign_volumes(records) if direction == "signed_net" else records
    resolved = locate(resolve_revisions(signed), calendar)
    per_series = resolved.groupBy("series").agg(
        F.sum("n_rows").alias("n_in"), F.count("*").alias("n_res"), F.count("volume").alias("n_obs"),
        F.count_if(F.col("volume").isNotNull() & (F.col("flow") == "I")).alias("n_imp"),
        F.count_if(F.col("volume").isNotNull() & (F.col("flow") == "E")).alias("n_exp"),
        F.count_if("estimated").alias("n_est"))
    total = lambda c: F.sum(c).cast("long")
    return per_series.agg(
        total("n_in").alias("input_rows"), total("n_res").alias("resolved_rows"),
        (total("n_in") - total("n_res")).alias("superseded_or_duplicate_rows"),
        F.count("*").alias("total_series"), F.lit(calendar.n_slots).cast("long").alias("periods_per_series"),
        total("n_imp").alias("observed_import_periods"), total("n_exp").alias("observed_export_periods"),
        (F.count("*") * calendar.n_slots - total("n_obs")).cast("long").alias("genuinely_missing_periods"),
        total("n_est").alias("estimated_rows_after_resolution"))


def daily_audit(records: DataFrame, direction="signed_net") -> DataFrame:
    """Per settlement day: raw rows, resolved rows, series, imports, exports, estimates."""
    signed = sign_volumes(records) if direction == "signed_net" else records
    observed = F.col("volume").isNotNull()
    return resolve_revisions(signed).groupBy("settle_date", "series").agg(
        F.sum("n_rows").alias("n_in"), F.count("*").alias("n_res"),
        F.count_if(observed & (F.col("flow") == "I")).alias("n_imp"),
        F.count_if(observed & (F.col("flow") == "E")).alias("n_exp"),
        F.count_if("estimated").alias("n_est")).groupBy("settle_date").agg(
        F.sum("n_in").alias("input_rows"), F.sum("n_res").alias("resolved_rows"),
        F.count("*").alias("total_series"), F.sum("n_imp").alias("observed_import_periods"),
        F.sum("n_exp").alias("observed_export_periods"), F.sum("n_est").alias("estimated_rows"))


def observed_by_month(panel: DataFrame) -> DataFrame:
    return panel.groupBy("series", F.date_format(local("ts"), "yyyy-MM").alias("month")).agg(
        F.count("value").alias("observed"))


def completeness(panel: DataFrame) -> DataFrame:
    """Missing periods and flatness (sample deviation; undefined counts as flat) per series."""
    return panel.groupBy("series").agg(
        F.count_if(F.col("value").isNull()).alias("missing_periods"),
        (F.coalesce(F.stddev_samp("value"), F.lit(0.0)) <= 1e-12).alias("constant_profile"))


def excluded_series(panel: DataFrame) -> DataFrame:
    """Series a complete-case study must drop, with the reasons."""
    return completeness(panel).where((F.col("missing_periods") > 0) | F.col("constant_profile"))


def complete_series(panel: DataFrame) -> DataFrame:
    """Rows of complete, varying series; decided inside the series partition, no join back."""
    w = whole(["series"])
    flagged = panel.withColumns({
        "_gap": F.count_if(F.col("value").isNull()).over(w),
        "_sd": F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0))})
    return flagged.where((F.col("_gap") == 0) & (F.col("_sd") > 1e-12)).drop("_gap", "_sd")


def series_union(*panels: DataFrame) -> DataFrame:
    """Ids seen in any season, for giving absent series explicit unknown rows."""
    ids = panels[0].select("series")
    for p in panels[1:]:
        ids = ids.union(p.select("series"))
    return ids.distinct()


def season_calendar(start: str, end: str) -> SettlementCalendar:
    """Season window widened by one day of context on both sides."""
    from datetime import date, timedelta
    shift = lambda d, k: (date.fromisoformat(d) + timedelta(days=k)).isoformat()
    return SettlementCalendar(shift(start, -1), shift(end, 1))


def combine_distinct(parts) -> DataFrame:
    """Concatenate record sets, drop exact duplicates, order by date and period."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates().orderBy("settle_date", "period")


def day_profiles(records: DataFrame, min_days: int, width: int = 48) -> DataFrame:
    """Fixed-width day profiles of series with at least ``min_days`` dates.

    A long day is cut to ``width`` values, a short one repeats its last value.
    """
    per_day = records.groupBy("series", "settle_date").agg(
        F.sort_array(F.collect_list(F.struct("period", "volume"))).alias("points"))
    days = F.count("*").over(Window.partitionBy("series"))
    values = F.slice(F.transform("points", lambda p: p["volume"]), 1, width)
    pad = F.array_repeat(F.element_at("vals", -1), F.lit(width) - F.size("vals"))
    return (per_day.withColumn("_days", days).where(F.col("_days") >= min_days)
            .select("series", "settle_date", values.alias("vals"))
            .select("series", "settle_date", F.concat("vals", pad).alias("profile")))


def normalise_by_max(panel: DataFrame) -> DataFrame:
    """value / max(value) per series; an all-zero series stays zero."""
    top = F.max("value").over(whole(["series"]))
    return panel.withColumn("scaled", F.when(top == 0, F.lit(0.0)).otherwise(F.col("value") / top))
