"""Spectral and low-run features of complete series, and the screening rules."""
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..checks import ContractError, guard
from ..functions.clock import local_date
from ..functions.spectrum import BANDS, band_area, densities, moments
from ..functions.windows import mark_runs, over_series, whole


@dataclass(frozen=True)
class RunRule:
    low_fraction: float = 0.35
    min_hours: float = 6
    following_hours: float = 8
    min_peak_fraction: float = 0.75


@dataclass(frozen=True)
class ScreenRule:
    """Fixed default weights and thresholds of the screening score."""

    temporal_weight: float = 0.8
    min_day_fraction: float = 0.2
    score_threshold: float = 0.25
    allow_signed_exports: bool = False


def segments(panel: DataFrame, by=("series",), n: int = 96) -> DataFrame:
    """Half-overlapping segments: each reading joins at most two, with its index inside."""
    if n < 96 or n % 2:
        raise ContractError("Use an even segment of at least 96 samples (48 hours)")
    half = n // 2
    size = F.count("*").over(whole(by))
    first = F.min("pos").over(whole(by))
    placed = panel.withColumns({"_size": size, "_at": F.col("pos") - first})
    placed = placed.withColumn("_size", guard(F.col("_size"), F.col("_size") < n,
                                              "At least 96 samples are needed for the spectral bands", "long"))
    seg = F.floor(F.col("_at") / half)
    out = placed.withColumn("segment", F.explode(F.array(seg, seg - 1)))
    out = out.where((F.col("segment") >= 0) & (F.col("segment") * half + n <= F.col("_size")))
    return out.withColumn("_idx", F.col("_at") - F.col("segment") * half)


def welch_density(panel: DataFrame, by=("series",), n: int = 96) -> DataFrame:
    """Mean one-sided density at the bins the bands need, and mean total area, per series."""
    parts = segments(panel, by, n).groupBy(*by, "segment").agg(*moments("value", "_idx", n))
    return parts.groupBy(*by).agg(*[F.avg(c).alias(name) for name, c in densities(n).items()])


def spectral_features(panel: DataFrame, by=("series",), n: int = 96) -> DataFrame:
    mean = welch_density(panel, by, n)
    out = mean.select(*by, *[band_area(n, *edges).alias(name) for name, edges in BANDS.items()], "total_power")
    share = lambda c: F.when(F.col("total_power") > 0, F.col(c) / F.col("total_power")).otherwise(0.0)
    return out.withColumns({"fraction_6_8h": share("power_6_8h"), "fraction_20_28h": share("power_20_28h"),
                            "frequency_resolution_cph": F.lit(2.0 / n)})


def low_runs(df: DataFrame, by, p10, amplitude, low_fraction, following: int, value="value") -> DataFrame:
    """Annotate rows with their low run: start flag, length, following peak, trough, censoring.

    ``_start`` rows carry the run; every step is a window on the same partition.
    """
    v, w = F.col(value), over_series(by)
    df = df.withColumn("_low", F.coalesce(v <= p10 + low_fraction * amplitude, F.lit(False)))
    df = mark_runs(df, "_low", by, run="_run")
    ahead = w.rowsBetween(1, following)
    df = df.withColumns({"_ahead": F.max(v).over(ahead), "_n_ahead": F.count("*").over(ahead)}).withColumn(
        "_first", F.min("pos").over(whole(by)) == F.col("pos"))
    # One more sort, by run and position, serves the ordered and then the whole-run windows.
    in_run = Window.partitionBy(*by, "_run")
    last = in_run.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({
        "_peak": F.last("_ahead").over(last), "_room": F.last("_n_ahead").over(last),
        "_start": F.col("_low") & (F.row_number().over(in_run.orderBy("pos")) == 1)})
    df = df.withColumns({"_len": F.count("*").over(in_run), "_trough": F.avg(v).over(in_run)})
    return df.withColumn("_censored", F.col("_start") & (F.col("_first") | (F.col("_room") < following)))


def temporal_rows(panel: DataFrame, by=("series",), rule=RunRule(), low_fraction=None) -> DataFrame:
    w = over_series(by)
    day = local_date("ts")
    df = panel.withColumns({"_ramp": (F.col("value") - F.lag("value").over(w)) * 2, "_date": day,
                            "_new_day": F.coalesce(F.lag(day).over(w) != day, F.lit(True))})
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.9))).over(whole(by))
    df = df.withColumn("_q", q).withColumns({"_p10": F.col("_q")[0], "_amp": F.col("_q")[1] - F.col("_q")[0]}).drop("_q")
    fraction = F.lit(rule.low_fraction) if low_fraction is None else F.col(low_fraction)
    return low_runs(df, by, F.col("_p10"), F.col("_amp"), fraction, int(2 * rule.following_hours))


def temporal_features(panel: DataFrame, by=("series",), rule=RunRule(), low_fraction=None, min_hours=None) -> DataFrame:
    """Low-run features; ``min_hours`` may list several thresholds (suffixed counts)."""
    df = temporal_rows(panel, by, rule, low_fraction)
    seen = F.col("_start") & ~F.col("_censored")
    hours = F.col("_len") / 2
    peak_ok = (seen & (F.col("_amp") > 0) & (F.col("_peak") > 0)
               & (F.col("_peak") >= F.col("_p10") + rule.min_peak_fraction * F.col("_amp")))
    limits = {"": rule.min_hours} if min_hours is None else {f"_{h}h": h for h in min_hours}
    out = df.groupBy(*by).agg(
        F.coalesce(F.max(F.when(seen, hours)), F.lit(0.0)).alias("longest_observed_low_hours"),
        # A set of days is bounded by the calendar; unlike count(distinct) it needs no further shuffle.
        *[F.size(F.collect_set(F.when(peak_ok & (hours >= h), F.col("_date")))).cast("long").alias(f"qualifying_start_days{s}")
          for s, h in limits.items()],
        F.count_if("_new_day").alias("_days"),
        F.count_if(seen).alias("observed_low_runs"), F.count_if(F.col("_censored")).alias("censored_low_runs"),
        F.max(F.when(seen & (F.col("_trough") > 0), F.col("_peak") / F.col("_trough"))).alias("max_peak_trough_ratio"),
        F.greatest(F.lit(0.0), F.max("_ramp")).alias("max_up_ramp_per_hour"),
        F.first("_amp").alias("p90_minus_p10"), F.count_if(F.col("value") < 0).alias("negative_periods"))
    return out.withColumns({f"qualifying_day_fraction{s}": F.col(f"qualifying_start_days{s}") / F.col("_days")
                            for s in limits}).drop("_days")


def extract_features(panel: DataFrame, by=("series",), rule=RunRule(), n: int = 96) -> DataFrame:
    return spectral_features(panel, by, n).join(temporal_features(panel, by, rule), list(by))


def screen(features: DataFrame, rule=ScreenRule(), day_fraction="qualifying_day_fraction", threshold=None) -> DataFrame:
    """Transparent score; spectra cannot override a temporal failure."""
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    daily, temporal = clip("fraction_20_28h"), clip(day_fraction)
    score = rule.temporal_weight * temporal + (1 - rule.temporal_weight) * daily
    ok = (temporal > 0) & (temporal >= rule.min_day_fraction)
    if not rule.allow_signed_exports:
        ok = ok & (F.col("negative_periods") == 0)
    limit = F.lit(rule.score_threshold) if threshold is None else F.col(threshold)
    out = features.withColumn("screening_score", score)
    out = out.withColumn("candidate", ok & (F.col("screening_score") >= limit))
    status = F.when(F.col("candidate"), "candidate").otherwise("not_flagged")
    if not rule.allow_signed_exports:
        status = F.when(F.col("negative_periods") > 0, "requires_review_negative_volume").otherwise(status)
    return out.withColumn("screening_status", status)


def screen_with_quality(filled: DataFrame, quality: DataFrame, run_rule=RunRule(), rule=ScreenRule(),
                        by=("series",)) -> DataFrame:
    """Every series gets a row; insufficient evidence is NULL, never false."""
    ready = filled.withColumn("_open", F.count_if(F.col("filled").isNull()).over(whole(by))).where(
        F.col("_open") == 0).withColumn("value", F.col("filled"))
    result = screen(extract_features(ready, by, run_rule), rule)
    out = quality.join(result, list(by), "left")
    status = F.when(~F.col("eligible"), "insufficient_evidence").otherwise(F.col("screening_status"))
    return out.withColumns({
        "candidate": F.when(F.col("eligible"), F.col("candidate")),
        "screening_status": F.when(F.col("status") == "imputed", F.concat(status, F.lit("_imputed"))).otherwise(status)})


# The sensitivity grid.
LOW_FRACTIONS, MIN_HOURS, THRESHOLDS = (0.25, 0.35, 0.45), (6, 8), (0.15, 0.25, 0.35)


def sensitivity(panel: DataFrame, run_rule=RunRule(), rule=ScreenRule()) -> DataFrame:
    """Candidate counts and label changes over the 3 x 2 x 3 grid.

    Only the low fraction changes the runs, so the panel is copied three times;
    hours and thresholds fan out on the per-series features.
    """
    by = ("series", "low_fraction")
    spectral = spectral_features(panel).select("series", "fraction_20_28h")
    copies = panel.withColumn("low_fraction", F.explode(F.array(*[F.lit(x) for x in LOW_FRACTIONS])))
    temporal = temporal_features(copies, by, run_rule, "low_fraction", MIN_HOURS)
    wide = temporal.join(spectral, "series").select(
        *by, "fraction_20_28h", "negative_periods",
        F.explode(F.array(*[F.struct(F.lit(h).alias("min_low_hours"), F.col(f"qualifying_day_fraction_{h}h").alias("f"))
                            for h in MIN_HOURS])).alias("h"))
    wide = wide.select(*by, "fraction_20_28h", "negative_periods", "h.min_low_hours",
                       F.col("h.f").alias("qualifying_day_fraction"),
                       F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("score_threshold"))
    labelled = screen(wide, rule, threshold="score_threshold")
    default = ((F.col("low_fraction") == run_rule.low_fraction) & (F.col("min_low_hours") == run_rule.min_hours)
               & (F.col("score_threshold") == rule.score_threshold))
    base = F.max(F.when(default, F.col("candidate"))).over(Window.partitionBy("series"))
    return labelled.withColumn("_base", base).groupBy("low_fraction", "min_low_hours", "score_threshold").agg(
        F.count_if("candidate").alias("candidate_count"),
        F.count_if(F.col("candidate") != F.col("_base")).alias("changed_vs_default"), F.count("*").alias("total_series"))


# The legacy integrated-spectrum thresholds by study period.
LEGACY_THRESHOLDS = {"weekdays": 0.0034, "weekdays_alternate": 0.0035, "weekend": 0.0075}


def legacy_low_frequency_psd(panel: DataFrame, by=("series",)) -> DataFrame:
    """Integrated low-frequency spectrum: bins -6..6 of the max-normalised power, Simpson rule.

    Volumes are unsigned in this study, so the largest bin is bin 0 and only
    bins 0..6 are summed; a negative reading is refused.
    """
    size, first = F.count("*").over(whole(by)), F.min("pos").over(whole(by))
    x = guard(F.col("value"), F.coalesce(F.col("value") < 0, F.lit(False)), "Unsigned volumes required", "double")
    placed = panel.withColumns({"_n": size, "_i": F.col("pos") - first, "_x": x})
    sums = [F.sum("_x").alias("c0")]
    for k in range(1, 7):
        angle = 2 * math.pi * k * F.col("_i") / F.col("_n")
        sums += [F.sum(F.col("_x") * F.cos(angle)).alias(f"c{k}"), F.sum(F.col("_x") * F.sin(angle)).alias(f"s{k}")]
    agg = placed.groupBy(*by).agg(F.first("_n").alias("n"), *sums)
    zero = F.col("c0") == 0
    power = {0: F.when(zero, 0.0).otherwise(1.0)}
    for k in range(1, 7):
        p = F.col(f"c{k}") * F.col(f"c{k}") + F.col(f"s{k}") * F.col(f"s{k}")
        power[k] = F.when(zero, 0.0).otherwise(p / (F.col("c0") * F.col("c0")))
    weights = [1, 4, 2, 4, 2, 4, 2, 4, 2, 4, 2, 4, 1]
    total = sum((weights[k + 6] * power[abs(k)] for k in range(-6, 7)), F.lit(0.0))
    return agg.select(*by, (total / (3 * F.col("n"))).alias("int_psd"))


def legacy_class(psd: DataFrame, threshold: float) -> DataFrame:
    return psd.withColumn("psd_index", F.when(F.col("int_psd") <= threshold, 1).otherwise(2))


# Map colours by screening status.
MAP_COLOURS = {
    "candidate": "#007f73", "not_flagged": "#b0bac5", "requires_review_negative_volume": "#dc933b",
    "candidate_imputed": "#43b6a7", "not_flagged_imputed": "#8599bb",
    "requires_review_negative_volume_imputed": "#dc933b", "insufficient_evidence": "#dc933b"}


def map_status(boundaries: DataFrame, screened: DataFrame) -> DataFrame:
    """Every boundary with its series' status and colour; grey when not analysed."""
    colours = F.create_map(*[F.lit(x) for kv in MAP_COLOURS.items() for x in kv])
    joined = boundaries.join(screened.select("series", "screening_status"), "series", "left")
    colour = F.coalesce(F.when(F.col("screening_status").isNotNull(),
                               F.try_element_at(colours, F.col("screening_status"))), F.lit("#eeeeee"))
    return joined.withColumn("map_color", colour)


def unmatched_series(screened: DataFrame, boundaries: DataFrame) -> DataFrame:
    return screened.join(boundaries.select("series"), "series", "left_anti")
