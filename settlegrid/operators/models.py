"""Fit diagnostics and models beyond the naive baselines."""
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window, functions as F

from ..checks import ContractError
from ..functions.windows import over_series
from ..session import durable
from .forecast import FeatureSpec, at_origins, backtest, build_features, from_origin, lookup_covariate, training_examples
from .smoothing import filter_through_gaps, fit_smoothing


def training_audit(examples: DataFrame) -> DataFrame:
    """One row: inner origins, examples, observed / missing targets, target range."""
    per = examples.groupBy("origin_pos").agg(F.count("*").alias("n"), F.count("target").alias("k"),
                                             F.min("pos").alias("a"), F.max("pos").alias("b"))
    return per.agg(F.count("*").alias("n_inner_origins"), F.sum("n").alias("n_examples"),
                   F.sum("k").alias("n_observed_targets"), (F.sum("n") - F.sum("k")).alias("n_missing_targets"),
                   F.min("a").alias("target_start"), F.max("b").alias("target_end"),
                   F.max("origin_pos").alias("last_inner_origin"))


def fit_diagnostics(examples: DataFrame, min_targets: int = 1) -> DataFrame:
    """Observed training targets and status per series; a failed series never gets a fallback."""
    n = F.col("n_train_examples")
    reason = F.when(n == 0, "no_training_targets").when(n < min_targets, "insufficient_observed_targets").otherwise("")
    return examples.groupBy("series").agg(F.count("target").alias("n_train_examples")).withColumn(
        "reason", reason).withColumn("status", F.when(F.col("reason") == "", "ok").otherwise("failed"))


# ---- pooled tree model over all series and leads --------------------------------------------

LEVEL = "series_level"


@dataclass(frozen=True)
class PooledTree:
    """Settings of the pooled regressor (gradient-boosted trees of MLlib)."""

    horizon: int = 48
    min_history: int = 336
    training_step: int = 48
    iterations: int = 20
    depth: int = 5
    learning_rate: float = 0.1
    seed: int = 7
    min_training_rows: int = 100
    max_training_rows: int | None = None
    train_window: int | None = None
    parallelism: int = 5
    spec: FeatureSpec = FeatureSpec()


def training_row_estimate(n_series: int, history: int, s: PooledTree) -> int:
    """Examples a fit would build, known before building any; raises over the row budget."""
    origins = len(range(s.min_history, history - s.horizon + 1, s.training_step))
    rows = origins * n_series * s.horizon
    if s.max_training_rows is not None and rows > s.max_training_rows:
        raise ContractError(f"{rows} training examples exceed max_training_rows={s.max_training_rows}")
    return rows


class PooledModel:
    """A fitted pooled regressor: predictions, per-series diagnostics and importance."""

    def __init__(self, settings, names, pipeline, counts):
        self.settings, self.names = settings, names
        self.pipeline, self.counts = pipeline, counts

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``prediction``; a series without training targets gets NULL, never a fallback."""
        known = self.counts.where("n_train_examples > 0").select("series", LEVEL, F.lit(True).alias("_known"))
        out = rows.join(known, "series", "left")
        if self.pipeline is None:
            return out.withColumn("prediction", F.lit(None).cast("double")).drop("_known", LEVEL)
        scored = self.pipeline.transform(prepare_matrix(out, self.names))
        return scored.select(*rows.columns, F.when(F.col("_known"), F.col("prediction")).alias("prediction"))

    def importance(self, origin_pos: int) -> DataFrame:
        """Importance per feature as rows, with its share."""
        tree = self.pipeline.stages[-1]
        assembled = self.pipeline.stages[-2].getInputCols()
        values = tree.featureImportances.toArray()
        total = float(values.sum())
        rows = [(n, origin_pos, float(v), float(v) / total if total > 0 else 0.0) for n, v in zip(assembled, values)]
        return self.counts.sparkSession.createDataFrame(rows, "feature string, origin_pos int, gain double, gain_fraction double")


def prepare_matrix(rows: DataFrame, names) -> DataFrame:
    """MLlib trees refuse missing values: keep an indicator and a constant fill side by side."""
    out = rows.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in names})
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})


def _levels(examples: DataFrame) -> DataFrame:
    """Training rows with their series' mean target over all other inner origins, so no target explains itself."""
    mine = examples.groupBy("series", "origin_pos").agg(F.sum("target").alias("_s"), F.count("target").alias("_k"))
    every = mine.groupBy("series").agg(F.sum("_s").alias("_all"), F.sum("_k").alias("_n"))
    level = mine.join(every, "series").select("series", "origin_pos", F.try_divide(
        F.col("_all") - F.coalesce("_s", F.lit(0.0)), F.col("_n") - F.col("_k")).alias(LEVEL))
    return examples.join(level, ["series", "origin_pos"])


def fit_pooled(examples: DataFrame, settings=PooledTree(), extra=(), kept=False) -> PooledModel:
    """Fit on observed targets of all series and leads; repeated fits are identical.

    ``kept`` says that ``examples`` is a filter of a stored table, so that it needs no copy of its own.

    A series is told by its lags and by its mean target outside the row's own inner origin: one encoding for any
    number of series, and no table per series in the tree.
    """
    names = [*settings.spec.names, *extra]
    if not kept:
        examples = durable(examples)  # the fit reads it many times; its lineage is long
    counts = examples.groupBy("series").agg(F.count("target").alias("n_train_examples"), F.avg("target").alias(LEVEL))
    if (counts.agg(F.sum("n_train_examples")).first()[0] or 0) < settings.min_training_rows:
        return PooledModel(settings, names, None, counts)
    names = [*names, LEVEL]
    inputs = names + [f"{c}__missing" for c in names if c != "lead"]
    stages = [VectorAssembler(inputCols=inputs, outputCol="features"),
              GBTRegressor(labelCol="target", maxIter=settings.iterations, maxDepth=settings.depth, stepSize=settings.learning_rate,
                           seed=settings.seed)]
    # Rows dealt by hash and sorted inside make repeated fits identical.
    ordered = prepare_matrix(_levels(examples).where(F.col("target").isNotNull()), names).repartition(
        "series", "origin_pos").sortWithinPartitions("series", "origin_pos", "pos")
    return PooledModel(settings, names, Pipeline(stages=stages).fit(ordered), counts)


def fit_origins(panel: DataFrame, plan, settings=PooledTree(), split="validation", covariate: DataFrame | None = None):
    """({origin: model or None}, target rows of all origins with their features): one fit per origin.

    The row budget is checked for the longest history before any feature is built. Without a training window the inner
    origins of one origin are those of the last that have ended, so features are built once. An origin with less
    history than ``min_history`` and a horizon gets no fit; leads beyond the trained horizon are refused.
    """
    if plan.longest > settings.horizon:
        raise ContractError(f"Leads up to {plan.longest} were asked of a model trained for {settings.horizon}")
    origins, panel = plan.positions(split), durable(panel)
    if settings.max_training_rows is not None:
        length = min(origins[-1], settings.train_window or origins[-1])
        training_row_estimate(panel.select("series").distinct().count(), length, settings)
    extra = ("temperature_c",) if covariate is not None else ()
    attach = (lambda df: lookup_covariate(df, covariate)) if covariate is not None else (lambda df: df)

    def built(origin):
        return attach(training_examples(panel, origin, settings.horizon, settings.min_history, settings.training_step, settings.spec,
                                        None, settings.train_window))

    def enough(origin):
        return min(origin, settings.train_window or origin) >= settings.min_history + settings.horizon
    whole = durable(built(origins[-1])) if settings.train_window is None and enough(origins[-1]) else None
    targets = durable(attach(build_features(panel.where(F.col("pos") < origins[-1] + plan.longest), origins, plan.longest, settings.spec)))

    def fitted(origin):
        if not enough(origin):
            return None
        if whole is None:
            return fit_pooled(built(origin), settings, extra)
        return fit_pooled(whole.where(F.col("origin_pos") <= origin - settings.horizon), settings, extra, True)
    with ThreadPoolExecutor(settings.parallelism) as pool:  # a fit is many small jobs, so a few run side by side
        return dict(zip(origins, pool.map(fitted, origins))), targets


def predict_origins(models: dict, rows: DataFrame) -> DataFrame:
    """``rows`` with the ``prediction`` of their own origin's model: each model scores all rows of its origin in one pass."""
    out = None
    for origin, model in models.items():
        mine = rows.where(F.col("origin_pos") == origin)
        scored = mine.withColumn("prediction", F.lit(None).cast("double")) if model is None else model.predict(mine)
        out = scored if out is None else out.unionByName(scored)
    return out


def pooled_backtest(panel: DataFrame, plan, settings=PooledTree(), split="validation", covariate: DataFrame | None = None):
    """Predictions of :func:`fit_origins` as case rows, and the importance tables.

    Origins without a fit and series without training targets get NULL predictions.
    """
    models, targets = fit_origins(panel, plan, settings, split, covariate)
    predicted = {o: predict_origins({o: m}, targets).select("series", "origin_pos", "pos", "prediction") for o, m in models.items()}
    importance = [m.importance(o) for o, m in models.items() if m is not None and m.pipeline is not None]
    return backtest(panel, plan, {"pooled_tree": lambda _, at, __: predicted[at.start]}, split), importance


def importance_summary(tables) -> DataFrame:
    """Mean, deviation and origin count of each feature's share."""
    out = None
    for t in tables:
        out = t if out is None else out.unionByName(t)
    return out.groupBy("feature").agg(F.avg("gain_fraction").alias("mean_gain_fraction"), F.stddev_samp("gain_fraction").alias("std_gain_fraction"),
                                      F.count_distinct("origin_pos").alias("n_origins"))


# ---- per-series models ------------------------------------------------------------------------

SEASON = 48


def seasonal_ar(panel: DataFrame, origins: range, horizon: int, min_observations=336, train_window: int | None = None) -> DataFrame:
    """y(t) = a y(t-1) + b y(t-48) + c y(t-49) by least squares on the complete rows before each origin.

    Normal-equation sums are trailing windows, so all origins come from one pass.
    For leads up to 48 the seasonal lags are history and the recursion is a fold
    over at most 48 known values. Where a gap hides one of them, the forecast is the
    conditional mean given everything observed before the origin, from a state-space
    filter over that series (``smoothing.filter_through_gaps``); nothing is filled in.
    Too little data or a singular system gives NULL and a reason.
    """
    if horizon > SEASON:
        raise ContractError("Seasonal AR forecasts at most one season ahead")
    w = over_series(["series"])
    lags = panel.withColumns({"_1": F.lag("value", 1).over(w), "_48": F.lag("value", SEASON).over(w), "_49": F.lag("value", SEASON + 1).over(w)})
    usable = F.col("value").isNotNull() & F.col("_1").isNotNull() & F.col("_48").isNotNull() & F.col("_49").isNotNull()
    xs = {"1": F.col("_1"), "2": F.col("_48"), "3": F.col("_49"), "y": F.col("value")}
    start = Window.unboundedPreceding if train_window is None else -(train_window - SEASON - 1)
    frame = w.rowsBetween(start, -1)
    seen = w.rowsBetween(Window.unboundedPreceding if train_window is None else -train_window, -1)
    sums = {f"s{i}{j}": F.sum(F.when(usable, xs[i] * xs[j])).over(frame) for i, j in ("11", "12", "13", "22", "23", "33", "1y", "2y", "3y")}
    rows = lags.withColumns({**sums, "_obs": F.count("value").over(seen), "_last": F.col("_1"),
                             "_syy": F.sum(F.when(usable, F.col("value") * F.col("value"))).over(frame),
                             "_rows": F.count_if(usable).over(frame), "_square": F.avg(F.col("value") * F.col("value")).over(seen)})
    m = {"11": "s11", "12": "s12", "13": "s13", "21": "s12", "22": "s22", "23": "s23", "31": "s13", "32": "s23", "33": "s33"}
    cell = lambda k: F.col(m[k])

    def det(c1, c2, c3):
        return (c1[0] * (c2[1] * c3[2] - c2[2] * c3[1]) - c2[0] * (c1[1] * c3[2] - c1[2] * c3[1])
                + c3[0] * (c1[1] * c2[2] - c1[2] * c2[1]))
    col = lambda j: [cell(f"{i}{j}") for i in (1, 2, 3)]
    rhs = [F.col("s1y"), F.col("s2y"), F.col("s3y")]
    d = det(col(1), col(2), col(3))
    size = F.col("s11") * F.col("s22") * F.col("s33")
    rows = rows.withColumn("_det", F.when(F.abs(d) > 1e-12 * size, d)).withColumns({
        "_a": det(rhs, col(2), col(3)) / F.col("_det"), "_b": det(col(1), rhs, col(3)) / F.col("_det"),
        "_c": det(col(1), col(2), rhs) / F.col("_det")})
    left = F.col("_syy") - F.col("_a") * F.col("s1y") - F.col("_b") * F.col("s2y") - F.col("_c") * F.col("s3y")
    rows = rows.withColumn("_noise", F.greatest(left, F.lit(0.0)) / F.col("_rows"))
    targets = at_origins(rows, origins, horizon).withColumn("_o", from_origin(["_a", "_b", "_c", "_last", "_obs", "_noise", "_square"]))
    targets = targets.withColumn("_k", F.col("_o._b") * F.col("_48") + F.col("_o._c") * F.col("_49"))
    steps = F.collect_list(F.struct(F.col("_k").alias("k"))).over(
        Window.partitionBy("series", "origin_pos").orderBy("lead").rowsBetween(Window.unboundedPreceding, 0))
    targets = targets.withColumn("_steps", steps)
    path = F.aggregate("_steps", F.col("_o._last"), lambda acc, s: F.col("_o._a") * acc + s["k"])
    minimum = max(min_observations, 2 * SEASON)
    reason = (F.when(F.col("_o._obs") < minimum, "insufficient_observations").when(F.col("_o._a").isNull(), "singular_system").otherwise(""))
    targets = targets.withColumns({"reason": reason, "_path": path})
    # From the first lead that a gap touches on, an origin's leads come from the filter; without gaps it has no groups.
    hidden = (F.col("reason") == "") & F.col("_path").isNull()
    gaps = targets.where(hidden).groupBy("series", "origin_pos").agg(F.first("_o").alias("_o"), F.min("lead").alias("_from"), F.max("lead").alias("_to"))
    folded = targets.where(~hidden).select("series", "origin_pos", "pos", "lead", F.when(F.col("reason") == "", F.col("_path")).alias("prediction"), "reason")
    out = folded.unionByName(_through_gaps(panel, gaps, train_window).withColumn("reason", F.lit("")))
    wild = ~(F.abs("prediction") < float("inf"))
    return out.withColumn("reason", F.when(wild, "nonfinite_forecast").otherwise(F.col("reason"))).withColumn(
        "prediction", F.when(~wild, F.col("prediction")))


def _through_gaps(panel: DataFrame, gaps: DataFrame, train_window) -> DataFrame:
    """Filtered forecasts of the origins in ``gaps``: a series, as long as the calendar, meets its own origins in one group."""
    schema = "series string, origin_pos int, pos int, lead int, prediction double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(values: pd.DataFrame, origins: pd.DataFrame) -> pd.DataFrame:
        if not len(origins):
            return pd.DataFrame({n: [] for n in names})
        base, last = int(values["pos"].min()), int(origins["origin_pos"].max())
        y = np.full(last - base, np.nan)
        past = values[values["pos"] < last]
        y[past["pos"].to_numpy() - base] = past["value"].to_numpy(float)
        origins = origins.sort_values("origin_pos")
        at, to = origins["origin_pos"].to_numpy() - base, int(origins["_to"].max())
        first = np.zeros(len(at), int) if train_window is None else np.maximum(at - train_window, 0)
        found = filter_through_gaps(y, at, origins[["_a", "_b", "_c"]].to_numpy(float), origins["_noise"].to_numpy(float),
                                    origins["_square"].to_numpy(float), to, first)
        leads = np.tile(np.arange(1, to + 1), len(at))
        out = origins.loc[origins.index.repeat(to), ["series", "origin_pos", "_from", "_to"]].assign(lead=leads, prediction=found.ravel())
        out["pos"] = out["origin_pos"] + leads - 1
        return out[(leads >= out["_from"]) & (leads <= out["_to"])][names]

    key = F.col("series").alias("series")  # both sides come from one panel; new names keep them apart
    touched = panel.join(gaps.select("series").distinct(), "series", "left_semi").select(key, "pos", "value")
    flat = gaps.select(key, "origin_pos", "_o._a", "_o._b", "_o._c", "_o._noise", "_o._square", "_from", "_to")
    return touched.groupBy("series").cogroup(flat.groupBy("series")).applyInPandas(run, schema)


def _ets_forecasts(y, stops, horizon, season, trend, damped, rounds):
    """{stop: (forecast, converged)} after each of ``stops`` rows of ``y``, whose parameters are fitted side by side."""
    factor = float(np.abs(y[:min(stops)]).max()) or 1.0  # rows that every origin knows
    _, phi, _, converged, states, _ = fit_smoothing(y / factor, season, stops, trend, damped, rounds=rounds)
    steps, out = np.arange(1, horizon + 1), {}
    for i, n in enumerate(sorted(stops)):
        carry = np.cumsum(phi[i] ** steps) if trend else np.zeros(horizon)
        level, slope, seasonal = (part[i] for part in states)
        out[n] = (level + slope * carry + seasonal[(n + steps - 1) % season]) * factor, bool(converged[i])
    return out


def ets(panel: DataFrame, origins: range, horizon: int, season=SEASON, trend=False, damped=False, min_observations=336,
        train_window: int | None = None, max_rounds: int = 100) -> DataFrame:
    """Additive exponential smoothing per series with fitted smoothing (and damping) parameters, for every origin.

    One group is one series, whose length the calendar bounds; without a training window the fits of all origins share
    each pass over it (``smoothing.fit_smoothing``). A gap, too little data, or a fit that has not converged after
    ``max_rounds`` gives NULL with a reason; nothing is interpolated. Forecasts scale with the input.
    """
    if damped and not trend:
        raise ContractError("Only a trend can be damped")
    positions, minimum = list(origins), max(min_observations, 2 * season)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        base, values, out = int(pdf["pos"].iloc[0]), pdf["value"].to_numpy(float), []
        whole = np.isfinite(values).cumprod().sum()  # rows before the first gap
        runs = {}
        if train_window is None:
            stops = [o - base for o in positions if minimum <= o - base <= whole]
            runs = _ets_forecasts(values[:max(stops)], stops, horizon, season, trend, damped, max_rounds) if stops else {}
        for o in positions:
            y = values[:max(0, o - base)]
            if train_window is not None:
                y = y[-train_window:]
            reason, forecast = "", np.full(horizon, np.nan)
            if np.isfinite(y).sum() < minimum:
                reason = "insufficient_observations"
            elif not np.isfinite(y).all():
                reason = "missing_training_values"
            else:
                forecast, converged = (runs if len(y) in runs else _ets_forecasts(
                    y, [len(y)], horizon, season, trend, damped, max_rounds))[len(y)]
                reason = "" if converged else "nonconvergence"
                reason = reason if np.isfinite(forecast).all() else "nonfinite_forecast"
                if reason:
                    forecast = np.full(horizon, np.nan)
            out.append(pd.DataFrame({"series": pdf["series"].iloc[0], "origin_pos": o, "pos": range(o, o + horizon),
                                     "lead": range(1, horizon + 1), "prediction": forecast, "reason": reason}))
        return pd.concat(out)
    schema = "series string, origin_pos int, pos int, lead int, prediction double, reason string"
    fitted = panel.select("series", "pos", "value").groupBy("series").applyInPandas(run, schema)
    return fitted.withColumn("prediction", F.when(~F.isnan("prediction"), F.col("prediction")))


def model_diagnostics(predictions: DataFrame) -> DataFrame:
    """Status and reason of every (series, origin) of a per-series model."""
    worst = F.max("reason")
    return predictions.groupBy("series", "origin_pos").agg(worst.alias("reason"), F.count("prediction").alias("n_predictions")).withColumn(
        "status", F.when(F.col("reason") == "", "ok").otherwise("failed"))
