"""Gap runs, bounded fills, quality grading, and the artificial masking study.

Fills never borrow across series and read original observations only.
"""
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..checks import ContractError, guard, positive_int
from ..functions.clock import clock_slot, day_type, local_date
from ..functions.windows import md5_order, next_known, over_series, previous_known, whole


@dataclass(frozen=True)
class FillPolicy:
    """Fixed default limits: research choices, not calibrated confidence."""

    method: str = "hybrid"
    max_missing_fraction: float = 0.2
    max_gap: int = 8
    linear_max_gap: int = 4
    min_donor_days: int = 2

    def __post_init__(self):
        if self.method not in ("hybrid", "none"):
            raise ContractError("Unknown fill method: use hybrid or none")
        if not 0 <= self.max_missing_fraction < 1:
            raise ContractError("max_missing_fraction lies in [0, 1)")
        for name in ("max_gap", "linear_max_gap", "min_donor_days"):
            positive_int(getattr(self, name), name)


def missing_runs(panel: DataFrame, by=("series",)) -> DataFrame:
    """Start (inclusive) and end (exclusive) of every missing stretch."""
    lost = panel.where(F.col("value").isNull())
    island = F.col("pos") - F.row_number().over(over_series(by))
    return lost.withColumn("_island", island).groupBy(*by, "_island").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("_island").withColumn(
        "length", F.col("end") - F.col("start"))


def missing_mask(panel: DataFrame) -> DataFrame:
    return panel.select("series", "pos", F.col("value").isNull().alias("missing"))


def gate(panel: DataFrame, policy=FillPolicy(), by=("series",)) -> DataFrame:
    """Add missing fraction, longest run and the fill permission of the series.

    On a dense panel the distance to the last known slot counts a run as it grows,
    so the longest run needs no run numbering and no second sort.
    """
    w = whole(by)
    known = F.when(F.col("value").isNotNull(), F.col("pos"))
    df = panel.withColumn("_p0", previous_known(known, by)).withColumn("_null", F.col("value").isNull())
    grown = F.col("pos") - F.coalesce(F.col("_p0"), F.min("pos").over(w) - 1)
    df = df.withColumn("_grown", F.when(F.col("_null"), grown).otherwise(0)).withColumns({
        "missing_before": F.count_if("_null").over(w),
        "missing_fraction": F.count_if("_null").over(w) / F.count("*").over(w),
        "longest_run": F.max("_grown").over(w)}).drop("_grown")
    return df.withColumn("allowed", (F.col("missing_fraction") <= policy.max_missing_fraction)
                         & (F.col("longest_run") <= policy.max_gap))


def eligibility(panel: DataFrame, policy=FillPolicy(), by=("series",)) -> DataFrame:
    runs = missing_runs(panel, by).groupBy(*by).agg(F.max("length").alias("longest_run"))
    share = panel.groupBy(*by).agg((F.count_if(F.col("value").isNull()) / F.count("*")).alias("missing_fraction"))
    return share.join(runs, list(by), "left").withColumn(
        "longest_run", F.coalesce("longest_run", F.lit(0))).withColumn(
        "allowed", (F.col("missing_fraction") <= policy.max_missing_fraction)
        & (F.col("longest_run") <= policy.max_gap))


def linear_fill(gated: DataFrame, policy=FillPolicy(), by=("series",)) -> DataFrame:
    """Straight line over short inner runs; adds ``filled`` and relabels ``source``."""
    known = F.when(F.col("value").isNotNull(), F.col("pos"))
    sides = gated.withColumn("_v0", previous_known("value", by)).withColumns(
        {"_v1": next_known("value", by), "_p1": next_known(known, by)})
    ok = (F.col("_null") & F.col("allowed") & (F.col("_p1") - F.col("_p0") - 1 <= policy.linear_max_gap))
    ok = F.lit(False) if policy.method == "none" else F.coalesce(ok, F.lit(False))
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("pos") - F.col("_p0")) / (F.col("_p1") - F.col("_p0"))
    return sides.withColumns({
        "filled": F.when(ok, line).otherwise(F.col("value")),
        "source": F.when(ok, "linear").otherwise(F.col("source"))}).drop("_v0", "_v1", "_p0", "_p1")


def seasonal_fill(filled: DataFrame, policy=FillPolicy(), by=("series",)) -> DataFrame:
    """Same clock slot and day type on other dates, median of day values.

    The days of a slot and day type are ranked once; the median without one of them lies on the middle ranks or one
    beside them, so three values and the number of days serve every open cell of the group. All windows lead with the
    series, whose partitioning they keep; nothing is packed, paired or joined. A date shares a slot at most twice
    (autumn), so its average is its median.
    """
    if policy.method == "none":
        return filled
    group = [*by, "_slot", "_type"]
    day, every = Window.partitionBy(*group, "_date"), Window.partitionBy(*group)
    rows = filled.withColumns({"_slot": clock_slot("ts"), "_date": local_date("ts")}).withColumn("_type", day_type("_date"))
    rows = rows.withColumn("_own", F.avg("value").over(day)).withColumn(
        "_day", F.when(F.row_number().over(day.orderBy("pos")) == 1, F.col("_own")))
    rows = rows.withColumns({"_n": F.count("_day").over(every), "_rank": F.row_number().over(every.orderBy(F.col("_day").asc_nulls_last())) - 1})
    half = F.floor(F.col("_n") / 2)
    rows = rows.withColumns({f"_s{k}": F.max(F.when(F.col("_rank") == half + k - 1, F.col("_day"))).over(every) for k in range(3)})
    # Taking the own day out moves up every rank from its value on.
    low, middle, own = F.col("_s0"), F.col("_s1"), F.col("_own")
    below = F.when(low < own, low).otherwise(middle)
    above = F.when(middle < own, middle).otherwise(F.col("_s2"))
    odd = F.col("_n") % 2 == 1
    without = F.when(odd, (below + above) / 2).otherwise(below)
    donated = F.when(own.isNotNull(), without).when(odd, middle).otherwise((low + middle) / 2)
    others = F.col("_n") - own.isNotNull().cast("int")
    hit = F.col("filled").isNull() & F.col("allowed") & (others >= policy.min_donor_days) & donated.isNotNull()
    return rows.withColumns({"source": F.when(hit, "seasonal_median").otherwise(F.col("source")),
                             "filled": F.when(hit, donated).otherwise(F.col("filled"))}).select(*filled.columns)


def fill_gaps(panel: DataFrame, policy=FillPolicy(), by=("series",)) -> DataFrame:
    """Gate, bounded line, seasonal median. ``value`` stays the original, ``filled`` is the result."""
    finite = panel.withColumn("value", guard(F.col("value"), F.coalesce(F.abs("value") == float("inf"), F.lit(False)),
                                             "Infinite values cannot be filled", "double"))
    return seasonal_fill(linear_fill(gate(finite, policy, by), policy, by), policy, by)


def quality(filled: DataFrame, by=("series",)) -> DataFrame:
    """One quality row per series of a :func:`fill_gaps` result."""
    gone = F.col("value").isNull()
    q = filled.groupBy(*by).agg(
        F.count("value").alias("observed_periods"), F.count_if(gone).alias("missing_before"),
        (F.count_if(gone) / F.count("*")).alias("missing_fraction"),
        F.max("longest_run").cast("long").alias("longest_run"),
        F.count_if(gone & F.col("filled").isNotNull()).alias("imputed"),
        F.count_if(F.col("filled").isNull()).alias("remaining"), F.stddev_pop("filled").alias("_sd"))
    ready = F.col("remaining") == 0
    return q.withColumns({
        "constant": ready & (F.col("_sd") <= 1e-12), "eligible": ready,
        "status": F.when(F.col("missing_before") == 0, "observed").when(ready, "imputed")
        .otherwise("insufficient_evidence")}).drop("_sd")


def flow_counts(panel: DataFrame) -> DataFrame:
    return panel.groupBy("series").agg(
        F.count_if(F.col("source") == "observed_import").alias("import_periods"),
        F.count_if(F.col("source") == "observed_export").alias("export_periods"))


def unbounded_linear(panel: DataFrame, by=("series",), out="filled") -> DataFrame:
    """Interpolate every gap; edges take the nearest value. A comparator only."""
    op = F.when(F.col("value").isNotNull(), F.col("pos"))
    sides = panel.withColumns({"_v0": previous_known("value", by), "_p0": previous_known(op, by)}).withColumns(
        {"_v1": next_known("value", by), "_p1": next_known(op, by)})
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("pos") - F.col("_p0")) / (F.col("_p1") - F.col("_p0"))
    return sides.withColumn(out, F.coalesce(F.col("value"), line, F.col("_v0"), F.col("_v1"))).drop(
        "_v0", "_v1", "_p0", "_p1")


# The masking patterns, as a share of slots or a block length.
RANDOM_PATTERNS = {"random_5pct": 0.05, "random_20pct": 0.2}
BLOCK_PATTERNS = {"block_2h": 4, "block_4h": 8, "block_6h": 12}


def mask_patterns(complete: DataFrame, seed=17) -> DataFrame:
    """Copies of complete series with cells hidden; ``truth`` keeps the reading.

    Hash order replaces a random stream: equal in distribution, reproducible anywhere.
    """
    n = F.count("*").over(whole(["series"]))
    copies = complete.withColumn("_n", n).withColumn(
        "pattern", F.explode(F.array(*[F.lit(p) for p in (*RANDOM_PATTERNS, *BLOCK_PATTERNS)])))
    draw = md5_order(F.lit(seed), "series", "pattern", "pos")
    rank = F.row_number().over(Window.partitionBy("series", "pattern").orderBy(draw, "pos"))
    start_hash = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "series", "pattern")), 1, 8), 16, 10)
    hide = F.lit(False)
    for name, share in RANDOM_PATTERNS.items():
        size = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
        hide = F.when(F.col("pattern") == name, F.col("_rank") <= size).otherwise(hide)
    for name, length in BLOCK_PATTERNS.items():
        begin = 1 + F.pmod(F.col("_draw"), F.col("_n") - length - 2)
        hide = F.when(F.col("pattern") == name,
                      (F.col("pos") >= begin) & (F.col("pos") < begin + length)).otherwise(hide)
    return copies.withColumns({"_rank": rank, "_draw": start_hash.cast("long")}).withColumn(
        "masked", hide).withColumns({"truth": F.col("value"), "value": F.when(~F.col("masked"), F.col("value"))}).drop(
        "_n", "_rank", "_draw")


def recovery(masked: DataFrame, policy=FillPolicy()) -> DataFrame:
    """Both methods' fills per (series, pattern, method), from one pass over the copies."""
    by = ("series", "pattern")
    both = unbounded_linear(fill_gaps(masked, policy, by), by, out="_line")
    pair = F.array(F.struct(F.lit("hybrid").alias("method"), F.col("filled").alias("filled")),
                   F.struct(F.lit("unbounded_linear_reference").alias("method"), F.col("_line").alias("filled")))
    return both.select(*by, "pos", "ts", "masked", "truth", F.explode(pair).alias("m")).select(
        *by, "m.method", "pos", "ts", "masked", "truth", "m.filled")


def recovery_errors(recovered: DataFrame) -> DataFrame:
    hit = F.col("masked") & F.col("filled").isNotNull()
    err = F.when(hit, F.col("filled") - F.col("truth"))
    out = recovered.groupBy("series", "pattern", "method").agg(
        F.count_if("masked").alias("masked_periods"), F.count_if(hit).alias("filled_periods"),
        F.sqrt(F.avg(err * err)).alias("rmse"), F.stddev_pop("truth").alias("_sd"))
    return out.withColumn("normalized_rmse", F.try_divide("rmse", "_sd")).drop("_sd")


def recovery_details(masked: DataFrame, policy=FillPolicy(), feature_fn=None) -> DataFrame:
    """Errors plus label and feature changes where a copy is complete again.

    ``feature_fn(df, by)`` returns candidate, longest low run and band fraction per key.
    """
    recovered = recovery(masked, policy)
    errors = recovery_errors(recovered)
    if feature_fn is None:
        return errors
    by = ("series", "pattern", "method")
    whole_again = recovered.withColumn("_open", F.count_if(F.col("filled").isNull()).over(whole(by))).where(
        F.col("_open") == 0).select(*by, "pos", "ts", F.col("filled").alias("value"))
    truth = recovered.where((F.col("method") == "hybrid") & (F.col("pattern") == "block_2h")).select(
        "series", F.lit("").alias("pattern"), F.lit("truth").alias("method"), "pos", "ts", F.col("truth").alias("value"))
    feats = feature_fn(whole_again.unionByName(truth), by)
    base = feats.where(F.col("method") == "truth").select(
        "series", F.col("candidate").alias("_c"), F.col("longest_observed_low_hours").alias("_l"),
        F.col("fraction_6_8h").alias("_f"))
    changes = feats.where(F.col("method") != "truth").join(base, "series").select(
        *by, (F.col("candidate") != F.col("_c")).alias("candidate_changed"),
        (F.col("longest_observed_low_hours") - F.col("_l")).alias("low_duration_error_hours"),
        (F.col("fraction_6_8h") - F.col("_f")).alias("band_fraction_error"))
    return errors.join(changes, list(by), "left")


def recovery_summary(details: DataFrame) -> DataFrame:
    changed = F.col("candidate_changed")
    return details.groupBy("method", "pattern").agg(
        F.count("*").alias("profiles"), F.sum("masked_periods").alias("masked_periods"),
        F.sum("filled_periods").alias("filled_periods"), F.avg("normalized_rmse").alias("mean_normalized_rmse"),
        F.count(changed).alias("assessed_labels"), F.avg(changed.cast("int")).alias("label_flip_fraction"),
        F.try_divide(F.sum("filled_periods"), F.sum("masked_periods")).alias("filled_fraction"))
