"""Association and sensitivity studies between demand and temperature.

A ``study`` table has (series, ts, demand, temperature_c). Per-series groups are
bounded by the calendar; anything pooled over series goes through exact
distributed ranks and quantiles.
"""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checks import ContractError, require_empty
from ..functions.clock import calendar_slices, season_name
from ..functions.ranks import exact_quantiles, pearson, spearman, window_average_rank
from ..functions.windows import hash_sample, md5_order, whole

SCOPES = ("season", "hour", "daytype", "year")


def correlate(study: DataFrame, by) -> DataFrame:
    """Guarded Pearson per group."""
    return study.groupBy(*by).agg(pearson("temperature_c", "demand").alias("pearson"))


def _finite(study):
    return study.where(F.col("demand").isNotNull() & F.col("temperature_c").isNotNull())


def calendar_residuals(study: DataFrame) -> DataFrame:
    """Demand and temperature minus their season x hour x day-type mean, paired rows only."""
    cell = whole(["series", "season", "hour", "daytype"])
    rows = _finite(calendar_slices(study))
    return rows.withColumns({"demand_residual": F.col("demand") - F.avg("demand").over(cell),
                             "temperature_residual": F.col("temperature_c") - F.avg("temperature_c").over(cell)})


def first_year_z(study: DataFrame, first_year: int) -> DataFrame:
    """z-score by the first year's mean and population deviation; NULL for a flat first year."""
    early = F.when(F.year("ts") == first_year, F.col("demand"))
    w = whole(["series"])
    sd = F.nullif(F.stddev_pop(early).over(w), F.lit(0.0))
    return study.withColumn("demand_z", (F.col("demand") - F.avg(early).over(w)) / sd)


def temperature_bin(t) -> Column:
    """Centre of a two-degree bin."""
    return F.floor(t / 2) * 2 + 1


def binned_sums(study_z: DataFrame) -> DataFrame:
    """Sums by series, year, season, hour band, day type and bin."""
    rows = _finite(calendar_slices(study_z)).withColumn("temperature_bin_c", temperature_bin(F.col("temperature_c")))
    return rows.groupBy("series", "year", "season", "hour_band", "daytype", "temperature_bin_c").agg(
        F.count("*").alias("n"), F.sum("demand").alias("demand_sum"), F.sum("demand_z").alias("z_sum"),
        F.count("demand_z").alias("n_z"), F.sum("temperature_c").alias("temperature_sum"))


def hourly_binned_sums(study_z: DataFrame) -> DataFrame:
    rows = _finite(calendar_slices(study_z)).withColumn("temperature_bin_c", temperature_bin(F.col("temperature_c")))
    return rows.groupBy("series", "hour", "temperature_bin_c").agg(
        F.count("*").alias("n"), F.sum("demand").alias("demand_sum"), F.sum("demand_z").alias("z_sum"),
        F.count("demand_z").alias("n_z"))


# The marginal dimensions.
MARGINS = ("year", "season", "hour_band", "daytype", "volume_stratum", "series")


def marginal_curves(binned: DataFrame, strata: DataFrame) -> DataFrame:
    """Seven marginal tables in long form: case-weighted and equal-series-weighted means.

    The binned sums, not the readings, are fanned out to the dimensions.
    """
    rows = binned.join(strata.select("series", F.col("stratum").alias("volume_stratum")), "series", "left")
    levels = F.array(F.struct(F.lit("overall").alias("d"), F.lit("all").alias("l")),
                     *[F.struct(F.lit(m).alias("d"), F.col(m).cast("string").alias("l")) for m in MARGINS])
    keys = ["dimension", "level", "temperature_bin_c"]
    fanned = rows.withColumn("m", F.explode(levels)).select(
        F.col("m.d").alias("dimension"), F.col("m.l").alias("level"), "temperature_bin_c", "series",
        "n", "demand_sum", "z_sum", "n_z", "temperature_sum")
    per = fanned.groupBy(*keys, "series").agg(*[F.sum(c).alias(c) for c in ("n", "demand_sum", "z_sum", "n_z", "temperature_sum")])
    per = per.withColumn("mean_z", F.try_divide("z_sum", "n_z"))
    return per.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum("demand_sum") / F.sum("n")).alias("mean_demand"),
        F.try_divide(F.sum("z_sum"), F.sum("n_z")).alias("mean_demand_z"),
        (F.sum("temperature_sum") / F.sum("n")).alias("mean_temperature"),
        F.avg("mean_z").alias("equal_series_mean_demand_z"), F.count("mean_z").alias("n_series_with_z"))


def displayable(curves: DataFrame, min_cases=200, min_series=10) -> DataFrame:
    return curves.where((F.col("n") >= min_cases) & (F.col("n_series_with_z") >= min_series))


def feasibility(study: DataFrame, first_year: int, strata: DataFrame, coverage: DataFrame) -> DataFrame:
    """Counts, first-year moments, raw and calendar-adjusted correlation per series."""
    early = F.when(F.year("ts") == first_year, F.col("demand"))
    both = F.col("demand").isNotNull() & F.col("temperature_c").isNotNull()
    raw = study.groupBy("series").agg(
        F.count("demand").alias("n_demand"), F.count("temperature_c").alias("n_weather"), F.count_if(both).alias("n_paired"),
        (F.count("temperature_c") / F.count("*")).alias("weather_fraction"), F.avg(early).alias("initial_mean"),
        F.stddev_pop(early).alias("initial_std"), pearson("temperature_c", "demand").alias("pearson"))
    adjusted = calendar_residuals(study).groupBy("series").agg(
        pearson("temperature_residual", "demand_residual").alias("calendar_adjusted_pearson"))
    return raw.join(adjusted, "series", "left").join(
        strata.select("series", F.col("stratum").alias("volume_stratum")), "series", "left").join(
        coverage.select("series", F.col("coverage_fraction").alias("weather_spatial_coverage")), "series", "left")


def _scoped(rows: DataFrame, scopes=SCOPES) -> DataFrame:
    pairs = F.array(F.struct(F.lit("overall").alias("s"), F.lit("all").alias("v")),
                    *[F.struct(F.lit(s).alias("s"), F.col(s).cast("string").alias("v")) for s in scopes])
    return rows.withColumn("_m", F.explode(pairs)).withColumns(
        {"scope": F.col("_m.s"), "slice": F.col("_m.v")}).drop("_m")


def _rank_correlation(rows: DataFrame, by, x="temperature_c", y="demand") -> DataFrame:
    """Distinct values are counted as the first rows of their ties, in the order that the ranks need anyway."""
    def first(value):
        order = Window.partitionBy(*by).orderBy(value)
        return F.row_number().over(order) == F.rank().over(order)
    ranked = rows.withColumns({"_rx": window_average_rank(x, by), "_nx": first(x)}).withColumns(
        {"_ry": window_average_rank(y, by), "_ny": first(y)})
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n_paired"), F.count_if("_nx").alias("n_unique_temperature"),
        F.count_if("_ny").alias("n_unique_demand"), pearson(x, y).alias("pearson"), pearson("_rx", "_ry").alias("spearman"))


def association_table(study: DataFrame) -> DataFrame:
    """Pearson and Spearman per series by overall, season, hour, day type and year, plus adjusted."""
    by = ("series", "scope", "slice")
    raw = _scoped(_finite(calendar_slices(study))).select(*by, "temperature_c", "demand")
    adjusted = calendar_residuals(study).select(
        "series", F.lit("calendar_adjusted").alias("scope"), F.lit("all").alias("slice"),
        F.col("temperature_residual").alias("temperature_c"), F.col("demand_residual").alias("demand"))
    return _rank_correlation(raw.unionByName(adjusted), by)


def correlation_summary(table: DataFrame) -> DataFrame:
    """Distribution over series of each correlation, per scope and slice."""
    long = table.select("scope", "slice", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("r")) for m in ("pearson", "spearman")])).alias("m")).select(
        "scope", "slice", "m.metric", "m.r")
    keys = ["scope", "slice", "metric"]
    head = long.groupBy(*keys).agg(
        F.count("*").alias("n_series"), F.count("r").alias("n_defined"), F.avg((F.col("r") < 0).cast("int")).alias("fraction_negative"),
        F.avg((F.abs("r") > 0.3).cast("int")).alias("fraction_abs_above_0_3"))
    return head.join(exact_quantiles(long, keys, "r", {"median": 0.5, "q25": 0.25, "q75": 0.75}), keys, "left")


def bin_medians(study_z: DataFrame) -> DataFrame:
    rows = _finite(study_z).withColumn("temperature_bin_c", temperature_bin(F.col("temperature_c")))
    return rows.groupBy("series", "temperature_bin_c").agg(
        F.count("*").alias("n"), F.median("demand").alias("median_demand"), F.median("demand_z").alias("median_demand_z"))


def hourly_sample(study_z: DataFrame, per_series=2000, seed=7) -> DataFrame:
    """At most ``per_series`` exact-hour pairs of each series, in hash order (the sample is the feature)."""
    rows = _finite(study_z).where(F.minute("ts") == 0)
    draw = md5_order(F.lit(seed), "series", F.unix_seconds("ts"))
    w = Window.partitionBy("series").orderBy("_draw", "ts")
    return rows.withColumn("_draw", draw).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_series).drop("_draw", "_rn")


def pooled_correlations(sample: DataFrame) -> DataFrame:
    """Sample correlations pooled over series, for raw demand and its z-score."""
    rows = _scoped(calendar_slices(sample)).select("scope", "slice", "temperature_c", F.explode(F.array(
        *[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in ("demand", "demand_z")])).alias("t")).select(
        "scope", "slice", "t.target", "temperature_c", "t.y")
    return spearman(rows, ["scope", "slice", "target"], "temperature_c", "y")


def mutual_information(x, y, neighbours=5, chunk=1000):
    """Nearest-neighbour estimate of mutual information in nats (Kraskov et al. 2004, first estimator)."""
    n = len(x)
    x, y = (v / v.std() if v.std() > 0 else v for v in (x, y))
    sx, sy = np.sort(x), np.sort(y)
    table = np.concatenate([[-np.euler_gamma], -np.euler_gamma + np.cumsum(1.0 / np.arange(1, n + 1))])
    total = 0.0
    for a in range(0, n, chunk):
        dx, dy = np.abs(x[a:a + chunk, None] - x), np.abs(y[a:a + chunk, None] - y)
        reach = np.partition(np.maximum(dx, dy), neighbours, axis=1)[:, neighbours]
        reach = np.nextafter(reach, 0)
        for v, s in ((x, sx), (y, sy)):
            inside = (np.searchsorted(s, v[a:a + chunk] + reach, side="right")
                      - np.searchsorted(s, v[a:a + chunk] - reach, side="left"))
            total += table[np.maximum(inside, 1) - 1].sum()
    return max(0.0, float(table[n - 1] + table[neighbours - 1] - total / n))


def _mi_row(x, y, seed, references=3):
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    if len(x) < 20 or x.std() == 0 or y.std() == 0:
        return len(x), None, None, None, None
    rng = np.random.default_rng(seed)
    noise = lambda v: v + 1e-10 * max(1.0, np.abs(v).mean()) * rng.standard_normal(len(v))
    xj, yj = noise(x), noise(y)
    value = mutual_information(xj, yj)
    control = np.array([mutual_information(rng.permutation(xj), yj) for _ in range(references)])
    return len(x), value, float(control.mean()), float(control.std(ddof=1)), value - float(control.mean())


def mi_table(sample: DataFrame, seed=7) -> DataFrame:
    """Mutual information per series and year (and all years) with shuffled references.

    A group is one series' sample, so its size is bounded by the sampling operator.
    """
    years = F.explode(F.array(F.lit("all"), F.year("ts").cast("string")))
    rows = sample.select("series", years.alias("year"), F.col("temperature_c").cast("double").alias("x"), F.col("demand").alias("y"))

    def estimate(pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib
        pdf = pdf.sort_values(["x", "y"])
        name, year = pdf["series"].iloc[0], pdf["year"].iloc[0]
        out = _mi_row(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), zlib.crc32(f"{name}:{year}:{seed}".encode()))
        return pd.DataFrame([[name, year, *out]], columns=MI_COLUMNS)
    return rows.groupBy("series", "year").applyInPandas(estimate, MI_SCHEMA)


MI_COLUMNS = ["series", "year", "n_sample", "mi_nats", "randomized_reference_mean", "randomized_reference_std", "mi_minus_reference"]
MI_SCHEMA = ("series string, year string, n_sample long, mi_nats double, randomized_reference_mean double, "
             "randomized_reference_std double, mi_minus_reference double")


def pooled_mi(sample: DataFrame, size=30000, seed=7) -> DataFrame:
    """The same diagnostic over a pooled sample of at most ``size`` rows, per target."""
    rows = sample.select("series", "ts", "temperature_c", F.explode(F.array(
        *[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in ("demand", "demand_z")])).alias("t")).where(
        F.col("t.y").isNotNull())
    drawn = rows.select(F.col("t.target").alias("target"), "series", "ts", "temperature_c", F.col("t.y").alias("y"))
    kept = hash_sample(drawn, ["target"], size, md5_order(F.lit(seed), "series", F.unix_seconds("ts"), "target"))
    rows = kept.select(F.col("target").alias("series"), F.lit("all").alias("year"),
                       F.col("temperature_c").cast("double").alias("x"), "y")

    def estimate(pdf):
        pdf = pdf.sort_values(["x", "y"])
        out = _mi_row(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), seed)
        return pd.DataFrame([[pdf["series"].iloc[0], "all", *out]], columns=MI_COLUMNS)
    return rows.groupBy("series", "year").applyInPandas(estimate, MI_SCHEMA).withColumnRenamed("series", "target").drop("year")


KNOTS = 6


def _basis(x, low, high):
    """Uniform cubic B-spline basis over [low, high] (last function dropped: the intercept covers it)."""
    step = (high - low) / (KNOTS - 1)
    out = []
    for j in range(KNOTS + 1):
        u = (x - low) / step - j + 3
        v = 4 - u
        piece = F.when((u < 0) | (u > 4), 0.0).when(u < 1, u * u * u / 6).when(
            u < 2, (-3 * u * u * u + 12 * u * u - 12 * u + 4) / 6).when(
            u < 3, (-3 * v * v * v + 12 * v * v - 12 * v + 4) / 6).otherwise(v * v * v / 6)
        out.append(piece)
    return out


def spline_curves(sample_z: DataFrame, alpha=1.0, points=150) -> DataFrame:
    """Ridge cubic-spline response of demand_z, equal total weight per series, by scope.

    The cluster reduces each scope to one row of weighted normal-equation sums; only
    those few rows meet the driver for a 7 x 7 solve.
    """
    rows = _scoped(calendar_slices(sample_z.where(F.col("demand_z").isNotNull() & F.col("temperature_c").isNotNull())),
                   ("season", "year"))
    keys = ["scope", "slice"]
    per = rows.groupBy(*keys, "series").agg(F.count("*").alias("_k"))
    span = rows.groupBy(*keys).agg(F.min("temperature_c").alias("_lo"), F.max("temperature_c").alias("_hi"))
    shape = per.groupBy(*keys).agg(F.count("*").alias("n_series"), F.sum("_k").alias("n_sample"))
    weighted = rows.join(per, [*keys, "series"]).join(span, keys).join(shape, keys).withColumn(
        "w", F.col("n_sample") / (F.col("_k") * F.col("n_series")))
    terms = {f"b{j}": b for j, b in enumerate(_basis(F.col("temperature_c"), F.col("_lo"), F.col("_hi")))}
    m = len(terms)
    based = weighted.withColumns(terms)
    w, y = F.col("w"), F.col("demand_z")
    sums = [F.sum(w).alias("sw"), F.sum(w * y).alias("sy")]
    sums += [F.sum(w * F.col(f"b{i}")).alias(f"m{i}") for i in range(m)]
    sums += [F.sum(w * F.col(f"b{i}") * y).alias(f"v{i}") for i in range(m)]
    sums += [F.sum(w * F.col(f"b{i}") * F.col(f"b{j}")).alias(f"g{i}_{j}") for i in range(m) for j in range(i, m)]
    fits = based.groupBy(*keys).agg(F.first("_lo").alias("lo"), F.first("_hi").alias("hi"), F.first("n_series").alias("n_series"),
                                    F.first("n_sample").alias("n_sample"), *sums)
    fits = fits.join(exact_quantiles(rows, keys, "temperature_c", {"q01": 0.01, "q99": 0.99}), keys)
    solved = []
    thin = fits.where("n_sample < 20 OR hi <= lo").select(*keys, "n_sample")
    require_empty(thin, "A scope has too few temperatures for a spline")
    for r in fits.collect():
        mean = np.array([r[f"m{i}"] for i in range(m)]) / r["sw"]
        gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)]) - r["sw"] * np.outer(mean, mean)
        right = np.array([r[f"v{i}"] for i in range(m)]) - mean * r["sy"]
        coef = np.linalg.solve(gram + alpha * np.eye(m), right)
        solved.append((r["scope"], r["slice"], r["lo"], r["hi"], r["q01"], r["q99"], r["n_sample"], r["n_series"],
                       float(r["sy"] / r["sw"] - mean @ coef), [float(c) for c in coef]))
    if not solved:
        raise ContractError("Too few temperatures for a spline")
    models = sample_z.sparkSession.createDataFrame(
        solved, "scope string, slice string, lo double, hi double, q01 double, q99 double, n_sample long, n_series long, "
                "intercept double, coef array<double>")
    grid = models.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "temperature_c", F.col("q01") + (F.col("q99") - F.col("q01")) * F.col("i") / (points - 1))
    fitted = F.col("intercept")
    for j, b in enumerate(_basis(F.col("temperature_c"), F.col("lo"), F.col("hi"))):
        fitted = fitted + b * F.get("coef", F.lit(j))
    return grid.select("scope", "slice", "temperature_c", fitted.alias("fitted_demand_z"), "n_sample", "n_series")


def year_stability(table: DataFrame, first: int, second: int) -> DataFrame:
    """Same sign of the correlation in two years (NULL unless both are defined)."""
    rows = table.where(F.col("scope") == "year")
    at = lambda m, y: F.max(F.when(F.col("slice") == str(y), F.col(m)))
    out = rows.groupBy("series").agg(*[at(m, y).alias(f"{m}_{y}") for m in ("pearson", "spearman") for y in (first, second)])
    for m in ("pearson", "spearman"):
        a, b = F.col(f"{m}_{first}"), F.col(f"{m}_{second}")
        both = a.isNotNull() & b.isNotNull()
        out = out.withColumns({f"{m}_both_defined": both, f"{m}_same_sign": F.when(both, F.signum(a) == F.signum(b))})
    return out


def season_derangement(origins: DataFrame, repeats: int, seed=7) -> DataFrame:
    """Donor origin of the same season for every origin and repeat; no origin is its own donor.

    Origins in hash order pass their profile to the next one, cyclically.
    """
    rows = origins.select("origin_pos", "origin").withColumns({
        "season": season_name(F.month(F.from_utc_timestamp("origin", "Europe/London"))),
        "repeat": F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))})
    rows = rows.withColumn("_h", md5_order(F.lit(seed), "repeat", "origin_pos"))
    w = Window.partitionBy("repeat", "season").orderBy("_h", "origin_pos")
    group = Window.partitionBy("repeat", "season")
    out = rows.withColumns({"_prev": F.lag("origin_pos").over(w), "_n": F.count("*").over(group),
                            "_last": F.max_by("origin_pos", F.struct("_h", "origin_pos")).over(group)})
    alone = F.raise_error(F.lit("A season has fewer than two origins to swap")).cast("int")
    return out.select("repeat", "season", "origin_pos",
                      F.when(F.col("_n") < 2, alone).otherwise(F.coalesce("_prev", "_last")).alias("donor_origin_pos"))


def permuted_rows(rows: DataFrame, donors: DataFrame, covariate="temperature_c") -> DataFrame:
    """Rows with the covariate of the donor origin at the same series and lead, per repeat."""
    lent = rows.select("series", F.col("origin_pos").alias("donor_origin_pos"), "lead", F.col(covariate).alias("_lent"))
    return rows.join(donors.select("repeat", "origin_pos", "donor_origin_pos"), "origin_pos").join(
        lent, ["series", "donor_origin_pos", "lead"], "left").withColumn(covariate, F.col("_lent")).drop("_lent")


def permutation_detail(rows: DataFrame, donors: DataFrame, predict, horizons=(8, 48), covariate="temperature_c") -> DataFrame:
    """Error sums with original and permuted covariate by series, origin, repeat and horizon.

    ``predict(df)`` adds ``prediction`` from the feature columns; ``target`` is the actual.
    """
    keys = ["series", "origin_pos", "pos"]
    base = predict(rows).select(*keys, F.col("prediction").alias("_base"))
    changed = predict(permuted_rows(rows, donors, covariate)).join(base, keys)
    ok = F.col("target").isNotNull() & F.col("_base").isNotNull() & F.col("prediction").isNotNull()
    e0 = F.when(ok, F.col("_base") - F.col("target"))
    e1 = F.when(ok, F.col("prediction") - F.col("target"))
    spans = F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: h >= F.col("lead"))
    return changed.withColumn("horizon", F.explode(spans)).groupBy("series", "origin_pos", "repeat", "horizon").agg(
        F.count_if(ok).alias("n"), F.coalesce(F.sum(F.abs(e0)), F.lit(0.0)).alias("original_abs"),
        F.coalesce(F.sum(F.abs(e1)), F.lit(0.0)).alias("permuted_abs"),
        F.coalesce(F.sum(e0 * e0), F.lit(0.0)).alias("original_squared"),
        F.coalesce(F.sum(e1 * e1), F.lit(0.0)).alias("permuted_squared"))


def permutation_summary(detail: DataFrame, by=()) -> DataFrame:
    """Mean, spread and range over repeats of the error increase."""
    per = detail.groupBy("horizon", "repeat", *by).agg(
        *[F.sum(c).alias(c) for c in ("n", "original_abs", "permuted_abs", "original_squared", "permuted_squared")])
    mae = lambda c: F.try_divide(c, "n")
    rmse = lambda c: F.sqrt(F.try_divide(c, "n"))
    per = per.select("horizon", "repeat", *by, mae("original_abs").alias("o"), mae("permuted_abs").alias("p"),
                     (rmse("permuted_squared") - rmse("original_squared")).alias("dr")).withColumn("d", F.col("p") - F.col("o"))
    return per.groupBy("horizon", *by).agg(
        F.avg("o").alias("original_mae"), F.avg("p").alias("mean_permuted_mae"), F.avg("d").alias("mean_delta_mae"),
        F.stddev_samp("d").alias("std_delta_mae"), F.min("d").alias("min_delta_mae"), F.max("d").alias("max_delta_mae"),
        F.avg("dr").alias("mean_delta_rmse"), F.count("*").alias("n_repeats"))
