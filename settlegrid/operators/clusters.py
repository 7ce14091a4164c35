"""Ward agglomeration of any number of points: mergeable clustering features, then nearest-neighbour chains.

A clustering feature is (weight, mean): all that Ward's distance between two groups of points needs.
"""
import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..checks import ContractError
from ..session import durable

LEAVES = 500            # features a task hands on; twice as many are agglomerated at a time
FAN = 16                # tasks whose features meet in one group
LEAF_VALUES = 4_000_000  # numbers in the leaves that every task sees: 32 MB
FEATURE = "g long, n double, z array<double>"


def ward_merges(weight: np.ndarray, mean: np.ndarray):
    """All merges of Ward's agglomeration as (height, i, j) in the order of their heights, by nearest-neighbour chains.

    ``i`` and ``j`` stand for the groups that hold these features. The height is the growth of the sum of squares.
    Quadratic in the features, in time and in memory.
    """
    m = len(weight)
    size, mean = weight.astype(float).copy(), mean - mean.mean(0)
    square = (mean ** 2).sum(1)
    d = np.maximum(square[:, None] + square - 2 * mean @ mean.T, 0)
    d *= size[:, None] * size / (size[:, None] + size)
    np.fill_diagonal(d, np.inf)
    live, chain, merges = np.ones(m, bool), [], []
    while len(merges) < m - 1:
        if not chain:
            chain.append(int(live.argmax()))
        a = chain[-1]
        b = int(d[a].argmin())
        if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:  # the one it came from wins a tie, so a chain ends
            b = chain[-2]
        else:
            chain.append(b)
            continue
        del chain[-2:]
        i, j, height = min(a, b), max(a, b), d[a, b]
        merges.append((height, i, j))
        both = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * height) / (size[i] + size[j] + size)
        live[j] = False
        size[i] += size[j]
        both = np.where(live, np.maximum(both, height), np.inf)
        both[i] = np.inf
        d[i], d[:, i] = both, both
        d[j], d[:, j] = np.inf, np.inf
    return sorted(merges, key=lambda x: x[0])  # stable: a merge stays behind those that it is made of


def ward_labels(weight, mean, k: int) -> np.ndarray:
    """Group numbers of the features once only ``k`` groups are left."""
    group = np.arange(len(weight))
    for _, i, j in ward_merges(weight, mean)[:max(0, len(weight) - k)]:
        group[group == group[j]] = group[i]
    return np.unique(group, return_inverse=True)[1]


def _added(label, weight, mean):
    """Features of the groups of a labelling."""
    n = np.bincount(label, weight)
    total = np.zeros((len(n), mean.shape[1]))
    np.add.at(total, label, mean * weight[:, None])
    return n, total / n[:, None]


def _condensed(parts, leaves):
    """At most ``leaves`` features of a stream of (weights, means); equal means are one feature from the start."""
    n, z = np.zeros(0), None
    for weight, mean in parts:
        for at in range(0, len(weight), leaves):
            w, x = weight[at:at + leaves], mean[at:at + leaves]
            n, z = (w, x) if z is None else (np.r_[n, w], np.vstack([z, x]))
            z, same = np.unique(z, axis=0, return_inverse=True)
            n = np.bincount(same.ravel(), n)
            if len(n) > leaves:
                n, z = _added(ward_labels(n, z, leaves), n, z)
    return n, z


def _frame(g, n, z):
    return pd.DataFrame({"g": g, "n": n, "z": list(z)})


def leaf_features(points: DataFrame, leaves: int = LEAVES, fan: int = FAN) -> DataFrame:
    """(g, n, z): at most ``leaves`` clustering features of (z, weight) rows; their weights add up to the points'.

    Each task condenses its rows as they stream by, then the features of ``fan`` tasks meet in a group, level by level.
    No group holds more than ``fan`` * ``leaves`` features. With at most ``leaves`` different vectors nothing is
    condensed and the features are these vectors.
    """
    def per_task(frames):
        parts = ((f["weight"].to_numpy(float), np.array(f["z"].tolist(), float)) for f in frames if len(f))
        n, z = _condensed(parts, leaves)
        if z is not None:
            yield _frame(TaskContext.get().partitionId(), n, z)

    def per_group(frame):
        frame = frame.sort_values("g", kind="stable")
        z = np.array(frame["z"].tolist(), float)
        order = np.lexsort(z.T[::-1])  # the rows' order in a shuffle does not matter
        return _frame(int(frame["g"].iloc[0]) // fan, *_condensed([(frame["n"].to_numpy(float)[order], z[order])], leaves))
    found = durable(points.select("weight", "z").mapInPandas(per_task, FEATURE))
    top = found.agg(F.max("g")).first()[0] or 0
    while top:
        found = durable(found.groupBy(F.floor(F.col("g") / fan).alias("_to")).applyInPandas(per_group, FEATURE))
        top //= fan
    return found


def agglomerate(points: DataFrame, k: int, weight: str | None = None, leaves: int = LEAVES) -> DataFrame:
    """``points`` with the column ``cluster``: Ward's agglomeration down to ``k`` clusters, 0 being the heaviest.

    Points are rows with coordinates ``z`` of one length; ``weight`` names a column of positive weights (else 1 each).
    Equal to the exact agglomeration as long as there are at most ``leaves`` different vectors; beyond, the cheapest
    merges are made inside tasks first, and a point goes where its nearest leaf goes. Rows whose ``z`` is null or
    holds a null or a value that is not finite get a null cluster. Fewer than ``k`` different vectors give as many
    clusters as there are. Clusters of one weight are numbered by their means. Raises for vectors of several lengths, a
    column ``cluster``, weights that are not positive, and leaves beyond ``LEAF_VALUES`` numbers.
    """
    if k < 1 or leaves < k:
        raise ContractError("agglomerate needs 1 <= k <= leaves")
    if "cluster" in points.columns:
        raise ContractError("points have a column named cluster already")
    z = F.col("z").cast("array<double>")
    sound = F.col("z").isNotNull() & ~F.exists(z, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    amount = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = points.where(sound).select(amount.alias("weight"), z.alias("z"))
    facts = rows.agg(F.min(F.size("z")).alias("low"), F.max(F.size("z")).alias("high"), F.bool_and(
        F.coalesce(F.col("weight") > 0, F.lit(False))).alias("weighed")).first()
    if facts["low"] is None:
        return points.withColumn("cluster", F.lit(None).cast("int"))
    if facts["low"] != facts["high"] or not facts["low"]:
        raise ContractError("points need coordinates of one length")
    if not facts["weighed"]:
        raise ContractError("weights must be positive")
    if leaves * facts["low"] > LEAF_VALUES:
        raise ContractError("leaves are too large for every task; take fewer or shorter coordinates")
    held = leaf_features(rows, leaves).toPandas()  # at most ``leaves`` rows
    means, n = np.array(held["z"].tolist(), float), held["n"].to_numpy(float)
    order = np.lexsort(means.T[::-1])
    means, n = means[order], n[order]
    group = ward_labels(n, means, k)
    total, centre = _added(group, n, means)
    rank = np.empty(len(total), "int32")
    rank[np.lexsort((*centre.T[::-1], -total))] = np.arange(len(total))
    number = rank[group]

    def nearest(column: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(column), 512):
            x = np.array(column.iloc[at:at + 512].tolist(), float)
            away = np.stack([((means - row) ** 2).sum(1) for row in x])
            out.append(number[away.argmin(1)])
        return pd.Series(np.concatenate(out) if out else np.zeros(0, "int32"))
    tell = F.pandas_udf(nearest, "int")
    # a row that is not sound is judged as the origin and then loses the answer
    origin = F.array_repeat(F.lit(0.0), int(facts["low"]))
    return points.withColumn("cluster", F.when(sound, tell(F.when(sound, z).otherwise(origin))))


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    """(cluster, n, share) of the rows that have a cluster."""
    counts = clustered.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # k rows
