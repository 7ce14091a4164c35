"""Representative-profile transfer of every regime in one job: keyed sums of products, one eigen solver per regime.

A regime is a (season, day type); its series have a 101-wide vector of their earlier days (48 slot medians, 48 slot
ranges, 5 behaviours) and the 48 slot medians of their later days.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .recurrence import held_out

REGIME = ["season", "day_type"]
# The two representations and their widths.
WIDTHS = {"median48": 48, "median48_iqr48_behaviour5": 101}
SLOTS = 48


def eligibility(summary: DataFrame, members: DataFrame, minimum=10) -> DataFrame:
    """Per regime: series in all, eligible series, and whether there are enough of them to fit."""
    total = summary.groupBy(*REGIME).agg(F.count_distinct("series").alias("total_series"))
    good = members.groupBy(*REGIME).agg(F.count_distinct("series").alias("eligible_series"))
    out = total.join(good, REGIME, "left").withColumn("eligible_series", F.coalesce("eligible_series", F.lit(0).cast("long")))
    return out.withColumn("fitted", F.col("eligible_series") >= minimum)


def _pairs(inputs: DataFrame, members: DataFrame, minimum: int, share: int) -> DataFrame:
    """(season, day_type, series, held_out, early, later) of the members of regimes with at least ``minimum`` of them."""
    enough = members.groupBy(*REGIME).agg(F.count_distinct("series").alias("_n")).where(F.col("_n") >= minimum).drop("_n")
    mine = held_out(members.select(*REGIME, "series").distinct().join(enough, REGIME), "series", share)
    both = inputs.groupBy(*REGIME, "series").agg(
        F.max(F.when(F.col("phase") == "development", F.col("vector"))).alias("early"),
        F.max(F.when(F.col("phase") == "holdout", F.slice("vector", 1, SLOTS))).alias("later"))
    return both.join(mine, [*REGIME, "series"])


def _scales(train: DataFrame) -> DataFrame:
    """Training mean and population deviation of every place of a regime's vectors; a flat place keeps scale 1."""
    cells = train.select(*REGIME, F.posexplode("early").alias("pos", "x"))
    sd = F.stddev_pop("x")
    per = cells.groupBy(*REGIME, "pos").agg(F.avg("x").alias("mean"), F.when(sd <= 1e-12, 1.0).otherwise(sd).alias("scale"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean", "scale")))  # as many places as a vector has
    return per.groupBy(*REGIME).agg(ordered.alias("_o")).select(
        *REGIME, F.transform("_o", lambda p: p["mean"]).alias("mean"), F.transform("_o", lambda p: p["scale"]).alias("scale"))


def _standard(frame):
    return (np.array(frame["early"].tolist(), float) - np.array(frame["mean"].tolist(), float)) / np.array(frame["scale"].tolist(), float)


def _products(scaled: DataFrame) -> DataFrame:
    """(season, day_type, i, row): sums of products of the standardised training vectors, added up per task and regime."""
    def work(frames):
        for frame in frames:
            x = _standard(frame)
            for key, at in frame.groupby(REGIME).indices.items():
                gram = x[at].T @ x[at]
                yield pd.DataFrame({"season": key[0], "day_type": key[1], "i": range(len(gram)), "row": list(gram)})
    parts = scaled.mapInPandas(work, "season string, day_type string, i int, row array<double>")
    cells = parts.select(*REGIME, "i", F.posexplode("row").alias("j", "v")).groupBy(*REGIME, "i", "j").agg(F.sum("v").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("j", "v")))
    return cells.groupBy(*REGIME, "i").agg(F.transform(ordered, lambda p: p["v"]).alias("row"))


def _axes(products: DataFrame, k: int) -> DataFrame:
    """(season, day_type, representation, axes): k unit directions of each width, from one regime's products as a group.

    The products of the narrow representation are a corner of the wide one's, so both come from the same sums.
    """
    def solve(key, frame):
        gram = np.array(frame.sort_values("i")["row"].tolist(), float)
        out = []
        for name, width in WIDTHS.items():
            values, vectors = np.linalg.eigh(gram[:width, :width])
            lead = vectors[:, ::-1][:, :k]
            lead = lead[:, values[::-1][:k] > 1e-12 * max(values[-1], 1e-300)]
            out.append({"season": key[0], "day_type": key[1], "representation": name, "axes": [c.tolist() for c in lead.T]})
        return pd.DataFrame(out)
    return products.groupBy(*REGIME).applyInPandas(solve, "season string, day_type string, representation string, axes array<array<double>>")


def regime_transfer(inputs: DataFrame, members: DataFrame, k=2, minimum=10, share=5) -> DataFrame:
    """How well a series' earlier vector tells its later slot medians, per regime: one row per representation and model.

    ``persistence`` takes the earlier medians as they are. ``pca`` scales the vectors by the training series, projects
    held-out ones on ``k`` components and decodes them. About one in ``share`` series is held out by a hash of its id;
    regimes with fewer than ``minimum`` members are refused and have no row. All regimes are keys of the same few
    aggregations, whose values are as wide as a vector.
    """
    rows = durable(_pairs(inputs, members, minimum, share))
    train = rows.where("NOT held_out")
    scaled = rows.join(_scales(train), REGIME)
    models = durable(_axes(_products(scaled.where("NOT held_out")), k))
    kinds = "season string, day_type string, representation string, model string, held_out boolean, square double, absolute double, cells long, left double, places long"

    def score(frames):
        for frame in frames:
            x = _standard(frame)
            out = []
            for i, r in enumerate(frame.itertuples(index=False)):
                width, later = WIDTHS[r.representation], np.asarray(r.later, float)
                axes = np.array([list(a) for a in r.axes], float).reshape(-1, width)
                back = (x[i, :width] @ axes.T) @ axes
                mean, scale = np.asarray(r.mean, float), np.asarray(r.scale, float)
                guesses = {"pca": back[:SLOTS] * scale[:SLOTS] + mean[:SLOTS]}
                if r.representation == "median48":
                    guesses["persistence"] = np.asarray(r.early, float)[:SLOTS]
                for name, guess in guesses.items():
                    e = guess - later
                    out.append((r.season, r.day_type, r.representation, name, r.held_out, (e ** 2).sum(), np.abs(e).sum(), SLOTS,
                                ((back - x[i, :width]) ** 2).sum() if name == "pca" else None, width))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in kinds.split(", ")])

    scores = scaled.join(models, REGIME).mapInPandas(score, kinds)
    test, fit = F.col("held_out"), ~F.col("held_out")
    part = lambda cond, c: F.sum(F.when(cond, F.col(c)))
    return scores.groupBy(*REGIME, "representation", "model").agg(
        F.count_if(fit).alias("train_series"), F.count_if(test).alias("test_series"),
        F.sqrt(part(test, "square") / part(test, "cells")).alias("later_median_rmse"),
        (part(test, "absolute") / part(test, "cells")).alias("later_median_mae"),
        (part(fit, "left") / part(fit, "places")).alias("reconstruction_mse_scaled"))
