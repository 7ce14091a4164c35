"""Daily recurrence of bounded low runs, by season, day type, week and phase.

Denominators are source-observed days: nothing is imputed here, and an unknown
day is NULL, never false.
"""
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import (as_col, clock_slot, day_type, local_date, monday_index, slots_between)
from ..functions.ranks import exact_quantiles, spearman
from ..functions.spectrum import day_fractions, day_moments
from ..functions.windows import md5_order, over_series, whole
from ..session import durable
from .features import low_runs


@dataclass(frozen=True)
class Season:
    name: str
    start: str
    end: str
    development_fraction: float = 0.6666666667

    @property
    def split(self) -> str:
        first, last = date.fromisoformat(self.start), date.fromisoformat(self.end)
        return (first + timedelta(days=int(((last - first).days + 1) * self.development_fraction))).isoformat()

    @property
    def weeks(self) -> list:
        first, last = date.fromisoformat(self.start), date.fromisoformat(self.end)
        monday, out = first - timedelta(days=first.weekday()), []
        while monday <= last:
            out.append(monday.isoformat())
            monday += timedelta(days=7)
        return out


@dataclass(frozen=True)
class RecurrenceRule:
    """Fixed default limits of the recurrence study."""

    low_fraction: float = 0.35
    following_hours: float = 8
    min_peak_fraction: float = 0.75
    durations: tuple = (6, 8)
    min_valid_days: int = 4
    min_coverage: float = 0.8
    repetitions: int = 1000
    seed: int = 7


BEHAVIOUR = ["longest_low_hours", "max_up_ramp_per_hour", "p90_minus_p10", "fraction_6_8h", "fraction_20_28h"]


def phase_of(day, split) -> Column:
    """Focal days whose three-day context crosses the split are purged."""
    d, s = as_col(day), F.lit(split).cast("date")
    return (F.when(F.date_add(d, 2) <= s, "development").when(F.date_sub(d, 1) >= s, "holdout")
            .otherwise("boundary_purged"))


def day_keys(df: DataFrame, season: Season) -> DataFrame:
    return df.withColumns({
        "season": F.lit(season.name), "day_type": day_type("date"),
        "week": F.date_sub("date", monday_index("date")), "phase": phase_of("date", season.split)})


def daily_features(panel: DataFrame, season: Season, rule=RecurrenceRule()) -> DataFrame:
    """One row per series and season day from its three-day context.

    Each reading joins the three focal days it is context for, by an explode, so
    the whole computation stays on the panel's series partitioning.
    """
    by = ("series", "date")
    d = local_date("ts")
    ctx = panel.select("series", "pos", "ts", "value", d.alias("_own")).withColumn(
        "date", F.explode(F.array(F.date_sub("_own", 1), F.col("_own"), F.date_add("_own", 1))))
    ctx = ctx.where(F.col("date").between(F.lit(season.start).cast("date"), F.lit(season.end).cast("date")))
    focal = F.col("_own") == F.col("date")
    ctx = ctx.withColumns({"_focal": focal, "_y": F.when(focal, F.col("value"))})
    ctx = ctx.withColumn("_ramp", (F.col("_y") - F.lag("_y").over(over_series(by))) * 2).withColumns({
        "_q": F.percentile("_y", F.array(F.lit(0.1), F.lit(0.9))).over(whole(by)),
        "_base": F.min(F.when(F.col("_focal"), F.col("pos"))).over(whole(by)),
        "_len_day": F.count_if("_focal").over(whole(by))}).withColumns({
        "_p10": F.col("_q")[0], "_amp": F.col("_q")[1] - F.col("_q")[0]}).drop("_q")
    runs = low_runs(ctx, by, F.col("_p10"), F.col("_amp"), rule.low_fraction, int(2 * rule.following_hours))
    mine = F.col("_start") & F.col("_focal")
    seen = mine & ~F.col("_censored")
    hours = F.col("_len") / 2
    good = seen & (F.col("_amp") > 0) & (F.col("_peak") > 0) & (
        F.col("_peak") >= F.col("_p10") + rule.min_peak_fraction * F.col("_amp"))
    agg = runs.groupBy(*by).agg(
        F.count("*").alias("_rows"), F.count("value").alias("_known"), F.count("_y").alias("observed_periods"),
        F.first("_len_day").alias("_n"), F.first("_amp").alias("p90_minus_p10"),
        F.greatest(F.lit(0.0), F.max("_ramp")).alias("max_up_ramp_per_hour"),
        F.count_if(F.col("_y") < 0).alias("negative_periods"),
        F.coalesce(F.max(F.when(seen, hours)), F.lit(0.0)).alias("longest_low_hours"),
        F.count_if(mine & F.col("_censored")).alias("censored_runs"),
        *[F.coalesce(F.max(good & (hours >= h)), F.lit(False)).alias(f"_q{h}") for h in rule.durations],
        F.max(F.when(F.col("_first"), F.col("_low"))).alias("_starts_low"),
        F.min(F.when(F.col("_focal"), F.col("_low"))).alias("_all_low"),
        *day_moments("_y", "(pos - _base)", "_len_day"))
    expected = slots_between(F.date_sub("date", 1), F.date_add("date", 2))
    complete = (F.col("_rows") == expected) & (F.col("_known") == expected)
    shares = day_fractions("_n")
    out = agg.withColumns({
        "expected_periods": slots_between("date", F.date_add("date", 1)), "_complete": complete,
        "fraction_6_8h": shares["power_6_8h"], "fraction_20_28h": shares["power_20_28h"]})
    censored = (F.col("p90_minus_p10") > 0) & ((F.col("_starts_low") & F.col("_all_low")) | (F.col("censored_runs") > 0))
    out = out.withColumn("invalid_reason", F.when(~F.col("_complete"), "missing_context").when(censored, "censored_run")
                         .otherwise("")).withColumn("valid_day", F.col("invalid_reason") == "")
    known = F.col("_complete")
    names = [*BEHAVIOUR, "negative_periods", "censored_runs"]
    out = out.select("series", "date", "expected_periods", "observed_periods", "valid_day", "invalid_reason",
                     *[F.when(known, F.col(c)).alias(c) for c in names],
                     *[F.when(F.col("valid_day"), F.col(f"_q{h}")).alias(f"qualifies_{h}h") for h in rule.durations])
    return day_keys(out, season)


def profiles(panel: DataFrame) -> DataFrame:
    """48-slot local profile in long form: repeated autumn slots averaged, spring slots absent."""
    return panel.groupBy("series", local_date("ts").alias("date"), clock_slot("ts").alias("slot")).agg(
        F.avg("value").alias("value"))


def draw_table(sizes: DataFrame, repetitions: int, seed: int) -> DataFrame:
    """(_w, _draws): for each number of weeks ``_w`` of ``sizes``, how often each repetition takes each week.

    Draw j of repetition r is the start of md5("seed|r|j"), so positions of one resample are independent of each other
    and every group of as many weeks shares them: hashes are made per number of weeks, not per group.
    """
    places = sizes.select("_w", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(repetitions).cast("long"))).alias("r")).select(
        "_w", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_w").cast("long") - 1)).alias("j"))
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), F.col("j").cast("string")).cast("binary"))
    taken = places.select("_w", "r", (F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % F.col("_w")).cast("int").alias("i"))
    counts = taken.groupBy("_w", "r", "i").agg(F.count("*").alias("c"))
    return counts.groupBy("_w", "r").agg(F.collect_list(F.struct("i", "c")).alias("picks")).groupBy("_w").agg(
        F.collect_list("picks").alias("_draws"))


def bootstrap_interval(blocks, draws, repetitions: int):
    """95% interval of sum(s)/sum(n) over resampled week blocks; NULL below 4 blocks.

    ``blocks`` is an array of (s, n) per week, bounded by the weeks of a season, and ``draws`` the entry of its size in
    :func:`draw_table`: one short weighted sum per repetition, in place.
    """
    def ratio(picks):
        def add(acc, p):
            b = F.get(blocks, p["i"])
            return F.struct((acc["s"] + p["c"] * b["s"]).alias("s"), (acc["n"] + p["c"] * b["n"]).alias("n"))
        zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(picks, zero, add, lambda a: F.try_divide(a["s"], a["n"]))
    ordered = F.array_sort(F.transform(draws, ratio))

    def quantile(values, p):
        h = (repetitions - 1) * p
        lo, frac = int(h), h - int(h)
        return F.get(values, F.lit(lo)) * (1 - frac) + F.get(values, F.lit(min(lo + 1, repetitions - 1))) * frac
    pair = F.transform(F.array(ordered), lambda v: F.struct(quantile(v, 0.025).alias("low"), quantile(v, 0.975).alias("high")))[0]
    return F.when((F.size(blocks) >= 4) & draws.isNotNull(), pair)


def summarize_days(daily: DataFrame, rule=RecurrenceRule(), weekly=False) -> DataFrame:
    """Recurrence by season x day type x series x phase (plus ``all``), or by week."""
    keys = ["season", "day_type", "series", "week" if weekly else "phase"]
    days = daily if weekly else daily.withColumn("phase", F.explode(F.array(F.col("phase"), F.lit("all"))))
    valid = F.col("valid_day")
    by_week = keys if weekly else [*keys, "week"]
    blocks = days.groupBy(*by_week).agg(
        F.count("*").alias("e"), F.count_if(valid).alias("v"),
        *[F.count_if(valid & F.col(f"qualifies_{h}h")).alias(f"q{h}") for h in rule.durations])
    extra = [] if weekly else [F.sort_array(F.collect_list(F.when(F.col("v") > 0, F.struct(
        "week", F.col("v").alias("n"), *[F.col(f"q{h}") for h in rule.durations])))).alias("_blocks")]
    out = blocks.groupBy(*keys).agg(F.sum("e").alias("expected_days"), F.sum("v").alias("valid_days"),
                                    *[F.sum(f"q{h}").alias(f"qualifying_days_{h}h") for h in rule.durations], *extra)
    coverage = F.col("valid_days") / F.col("expected_days")
    enough = (F.col("valid_days") >= rule.min_valid_days) & (coverage >= rule.min_coverage)
    out = out.withColumns({"coverage": coverage, "evidence_status": F.when(enough, "sufficient").otherwise(
        "insufficient_evidence")})
    if not weekly:
        out = durable(out)  # one row per group: read for the sizes and again for the intervals
        sizes = out.select(F.size("_blocks").alias("_w")).where("_w >= 4").distinct()
        out = out.withColumn("_w", F.size("_blocks")).join(draw_table(sizes, rule.repetitions, rule.seed), "_w", "left").drop("_w")
    for h in rule.durations:
        out = out.withColumn(f"observed_pattern_frequency_{h}h", F.try_divide(f"qualifying_days_{h}h", "valid_days"))
        if not weekly:
            pairs = F.transform("_blocks", lambda b: F.struct(b[f"q{h}"].alias("s"), b["n"].alias("n")))
            ci = F.transform(F.array(pairs), lambda p: bootstrap_interval(p, F.col("_draws"), rule.repetitions))[0]
            out = out.withColumn("_ci", ci).withColumns(
                {f"ci_low_{h}h": F.col("_ci.low"), f"ci_high_{h}h": F.col("_ci.high")}).drop("_ci")
    return out if weekly else out.drop("_blocks", "_draws")


def representative_slots(daily: DataFrame, profile: DataFrame) -> DataFrame:
    """Median and IQR of each slot over the valid days of a series, regime and phase."""
    days = daily.where("valid_day").select("season", "day_type", "phase", "series", "date")
    return profile.join(days, ["series", "date"]).groupBy("season", "day_type", "phase", "series", "slot").agg(
        F.median("value").alias("median"), (F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr"))


def representative_behaviour(daily: DataFrame) -> DataFrame:
    return daily.where("valid_day").groupBy("season", "day_type", "phase", "series").agg(
        *[F.median(c).alias(c) for c in BEHAVIOUR])


def representative_inputs(daily: DataFrame, profile: DataFrame) -> DataFrame:
    """101-wide vector: 48 medians, 48 IQRs, 5 behaviours (NULL where a slot never occurs)."""
    keys = ["season", "day_type", "phase", "series"]
    spread = representative_slots(daily, profile).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("median", "iqr")))).alias("m"))
    slots = F.sequence(F.lit(0), F.lit(47))
    at = lambda part: F.transform(slots, lambda s: F.try_element_at(F.col("m"), s)[part])
    return spread.join(representative_behaviour(daily), keys).select(
        *keys, F.concat(at("median"), at("iqr"), F.array(*BEHAVIOUR)).alias("vector"))


def cohort(summary: DataFrame, inputs: DataFrame) -> DataFrame:
    """Series with sufficient evidence and finite vectors in both phases, per regime."""
    keys = ["season", "day_type", "series"]
    both = F.col("phase").isin("development", "holdout")
    good = summary.where(both & (F.col("evidence_status") == "sufficient")).select(*keys, "phase")
    width = F.when(F.col("phase") == "holdout", F.slice("vector", 1, 48)).otherwise(F.col("vector"))
    finite = inputs.where(both & ~F.exists(width, lambda v: v.isNull())).select(*keys, "phase")
    return good.intersect(finite).groupBy(*keys).agg(F.count("*").alias("n")).where("n = 2").drop("n")


def held_out(ids: DataFrame, key="series", share=5) -> DataFrame:
    """Hash split of a cohort; about one in ``share`` series is held out."""
    h = F.conv(F.substring(md5_order(key), 1, 8), 16, 10).cast("long")
    return ids.withColumn("held_out", F.pmod(h, F.lit(share)) == 0)


def persistence_score(slots: DataFrame, members: DataFrame) -> DataFrame:
    """Earlier slot medians as forecast of later ones, over the given series."""
    keys = ["season", "day_type", "series", "slot"]
    early = slots.where("phase = 'development'").select(*keys, F.col("median").alias("early"))
    late = slots.where("phase = 'holdout'").select(*keys, F.col("median").alias("late"))
    err = F.col("early") - F.col("late")
    per = early.join(late, keys).join(members.select("season", "day_type", "series"), keys[:3], "left_semi")
    return per.groupBy("season", "day_type").agg(
        F.count_distinct("series").alias("n_series"), F.sqrt(F.avg(err * err)).alias("later_median_rmse"),
        F.avg(F.abs(err)).alias("later_median_mae"))


def regime_summary(daily: DataFrame, summary: DataFrame) -> DataFrame:
    """Coverage, medians across series, and early/late agreement, per regime."""
    keys = ["season", "day_type"]
    full = summary.where("phase = 'all'")
    head = full.groupBy(*keys).agg(
        F.count("*").alias("n_series"), F.count_if(F.col("evidence_status") == "sufficient").alias("sufficient_series"),
        F.sum("valid_days").alias("valid_series_days"), F.sum("expected_days").alias("expected_series_days"))
    days = daily.groupBy(*keys).agg(F.count_distinct("date").alias("calendar_days"))
    medians = exact_quantiles(full, keys, "observed_pattern_frequency_6h", {"median_recurrence_6h": 0.5}).join(
        exact_quantiles(full, keys, "observed_pattern_frequency_8h", {"median_recurrence_8h": 0.5}), keys)
    f = F.col("observed_pattern_frequency_6h")
    pairs = summary.groupBy(*keys, "series").agg(
        F.max(F.when(F.col("phase") == "development", f)).alias("early"),
        F.max(F.when(F.col("phase") == "holdout", f)).alias("late")).where(
        F.col("early").isNotNull() & F.col("late").isNotNull()).withColumn("change", F.abs(F.col("late") - F.col("early")))
    agreement = spearman(pairs, keys, "early", "late").select(
        *keys, F.col("n_paired").alias("paired_series"), F.col("spearman").alias("early_late_spearman_6h"))
    change = exact_quantiles(pairs, keys, "change", {"median_absolute_change_6h": 0.5})
    return head.join(days, keys).join(medians, keys, "left").join(agreement, keys, "left").join(change, keys, "left")


def reference_week(daily: DataFrame, summary: DataFrame, season: str, start: str, end: str, kind="weekday") -> DataFrame:
    """Frequencies in a reference week, in the whole season, and on the season's other days."""
    mine = daily.where(F.col("season") == season)
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    rate = lambda cond, c: F.avg(F.when(cond & F.col("valid_day"), F.col(c).cast("int")))
    other = ~inside & (F.col("day_type") == kind)
    per = mine.groupBy("series").agg(
        F.count_if(inside).alias("reference_expected_days"), F.count_if(inside & F.col("valid_day")).alias("reference_valid_days"),
        rate(inside, "qualifies_6h").alias("reference_frequency_6h"), rate(inside, "qualifies_8h").alias("reference_frequency_8h"),
        rate(other, "qualifies_6h").alias("other_days_frequency_6h"))
    full = summary.where((F.col("season") == season) & (F.col("day_type") == kind) & (F.col("phase") == "all")).select(
        "series", "observed_pattern_frequency_6h")
    return per.where("reference_expected_days > 0").join(full, "series", "left").withColumns({
        "absolute_difference_6h": F.abs(F.col("reference_frequency_6h") - F.col("observed_pattern_frequency_6h")),
        "absolute_difference_other_days_6h": F.abs(F.col("reference_frequency_6h") - F.col("other_days_frequency_6h"))})


def reference_gap(comparison: DataFrame, limit=0.2) -> DataFrame:
    """Median gap to the other days and the number of series at or past ``limit``."""
    gap = "absolute_difference_other_days_6h"
    tagged = comparison.withColumn("_g", F.lit("all"))
    counts = tagged.groupBy("_g").agg(F.count_if(F.col(gap) >= limit).alias("series_at_least_limit"))
    return counts.join(exact_quantiles(tagged, ["_g"], gap, {"median_gap": 0.5}), "_g", "left").drop("_g")


def model_summary(scores: DataFrame, keys=("season", "day_type", "representation", "model")) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg("later_median_rmse").alias("mean_later_median_rmse"),
                                     F.stddev_samp("later_median_rmse").alias("sd_later_median_rmse"),
                                     F.count("*").alias("runs"))


def weekly_matrix(weekly: DataFrame, season: Season, kind: str, value="observed_pattern_frequency_6h") -> DataFrame:
    """Series x week matrix with the row mean, ordered by it."""
    rows = weekly.where((F.col("season") == season.name) & (F.col("day_type") == kind))
    matrix = rows.withColumn("week", F.col("week").cast("string")).groupBy("series").pivot("week", season.weeks).agg(F.first(value))
    mean = rows.groupBy("series").agg(F.avg(value).alias("mean_frequency"))
    return matrix.join(mean, "series").orderBy("mean_frequency", "series")


def run_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("series").agg(F.count("*").alias("n"), F.count_if("valid_day").alias("v")).agg(
        F.count("*").alias("total_series"), F.sum("n").alias("daily_rows"), F.sum("v").alias("valid_daily_rows"))
