"""Hard negatives by a vertical scan: dimensions in each anchor's own order, bounds on the rest, exact windows."""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checks import ContractError, guard
from ..functions.ranks import ordered_positions
from .common import partitions, stored

ANCHORS = 4096            # anchors of a block
ROWS = (1024, 16_384)     # least and most rows of a block
STEP = 8                  # dimensions read between two bounds
NO_ID = 2 ** 63 - 1       # stands for a null id in a block: last among ties
WIDE = 2 ** 60            # beyond every score
FOUND = "anchor long, place int, tag long, id long, score long"


def integer_vector(vector: Column, scale: int) -> Column:
    """Each entry x as floor(scale * x), a 32-bit integer; null where the vector or an entry is null or not finite."""
    real = lambda c: c.cast("double")
    known = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(real(c)) < float("inf")))
    entry = lambda c: guard(F.floor(real(c) * scale), F.abs(real(c) * scale) >= 2.0 ** 31, "entry does not fit 32 bits", "bigint").cast("int")
    return F.when(known, F.transform(vector, entry))


# --- one anchor against the columns of one block (numpy) ---

def scan(a, columns, low, high, alive, windows, k: int, ids, tags):
    """For each window (least, most) the ``k`` rows of a block with the highest scores inside it, as (row, score) arrays.

    ``columns`` holds one array per dimension, ``low`` and ``high`` their ends, ``alive`` the rows that may count. The
    dimensions are read in falling order of the anchor's magnitudes. After every few the score so far plus the least
    and the most that the unread dimensions can add bounds each row: rows that cannot reach a window leave the bitmap,
    and so do rows that cannot reach the k-th best of the rows certain to be inside it. What is left after the last
    dimension has its exact score; ties go to the smaller id, then tag.
    """
    d = len(a)
    order = np.argsort(-np.abs(a), kind="stable")
    ends = a[:, None] * np.c_[low, high]
    rest_low = np.r_[np.cumsum(ends.min(1)[order][::-1])[::-1], 0] if d else np.zeros(1)
    rest_high = np.r_[np.cumsum(ends.max(1)[order][::-1])[::-1], 0] if d else np.zeros(1)
    m = columns.shape[1]
    place = np.flatnonzero(alive)
    score = np.zeros(len(place), columns.dtype)
    least = [w[0] for w in windows]
    for start in range(0, d, STEP):
        dims = order[start:start + STEP]
        if 2 * len(place) >= m:
            score = score + (a[dims] @ columns[dims])[place]
        else:
            score = score + a[dims] @ columns[dims[:, None], place]
        below, above = rest_low[start + len(dims)], rest_high[start + len(dims)]
        keep = np.zeros(len(place), bool)
        for w, (_, most) in enumerate(windows):
            sure = score[(score + below >= least[w]) & (score + above <= most)]
            if len(sure) >= k:
                least[w] = max(least[w], float(np.partition(sure, len(sure) - k)[len(sure) - k]) + below)
            keep |= (score + above >= least[w]) & (score + below <= most)
        if not keep.all():
            place, score = place[keep], score[keep]
            if not len(place):
                break
    for w, (_, most) in enumerate(windows):
        inside = np.flatnonzero((score >= least[w]) & (score <= most))
        if len(inside) > k:
            worst = np.partition(score[inside], len(inside) - k)[len(inside) - k]
            inside = inside[score[inside] >= worst]
        best = inside[np.lexsort((tags[place[inside]], ids[place[inside]], -score[inside]))][:k]
        yield place[best], score[best]


def _exact(anchors, columns):
    """Both sides as the narrowest float that holds every partial score exactly."""
    most = float((np.abs(anchors).max(0, initial=0).astype(float) * np.abs(columns).max(1, initial=0)).sum())
    if most >= 2.0 ** 53:
        raise ContractError("scores beyond 2^53 are not exact")
    kind = np.float32 if most < 2.0 ** 23 else np.float64
    return anchors.astype(kind), columns.astype(kind)


# --- blocks ---

def _pack(frame: pd.DataFrame) -> dict:
    vectors = np.array(frame["v"].tolist(), np.int32)
    return {"n": len(frame), "tags": frame["tag"].to_numpy(np.int64).tobytes(), "labels": frame["label"].to_numpy(np.int64).tobytes(),
            "ids": frame["id"].to_numpy(np.int64).tobytes(), "columns": np.ascontiguousarray(vectors.reshape(len(frame), -1).T).tobytes()}


def blocks(rows: DataFrame, size: int, windows: bool = False) -> DataFrame:
    """Rows (tag, id, label, v) as blocks of at most ``size`` rows in the order of (label, tag), one row per block.

    A block lists its labels and holds the vectors dimension by dimension. Where it starts is a matter of positions in
    the whole order, so a label of a third of all rows fills many blocks and small labels share one.
    """
    place = ordered_positions(rows, "label", "tag").withColumn("block", F.floor(F.col("position") / size))

    def work(key, frame):
        packed = _pack(frame)
        if windows:
            wide = max(len(w) for w in frame["windows"])
            packed["windows"] = np.array([[*[(w["place"], w["least"], w["most"]) for w in ws], *[(-1, 1, 0)] * (wide - len(ws))]
                                          for ws in frame["windows"]], np.int64).tobytes()
        return pd.DataFrame([{"block": key[0], "held": sorted(set(frame["label"])), **packed}])

    kinds = "block long, held array<long>, n long, tags binary, labels binary, ids binary, columns binary" + ", windows binary" * windows
    kept = ["block", "tag", "id", "label", "v"] + ["windows"] * windows
    return stored(place.select(*kept).groupBy("block").applyInPandas(work, kinds))


def _block(row, name):
    n = int(row[f"{name}_n"])
    ints = lambda col, kind=np.int64: np.frombuffer(row[f"{name}_{col}"], kind)
    return ints("tags"), ints("ids"), ints("labels"), ints("columns", np.int32).reshape(-1, n)


def scan_pairs(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(anchor, place, tag, id, score): each anchor's best ``k`` rows a window and pair of blocks.

    ``pairs`` (a, b) names the blocks that meet. Each pair is one group of two rows' worth of arrays, so a task holds
    two blocks at a time; only scores inside a window leave it.
    """
    left = anchors.select(*[F.col(c).alias("a" if c == "block" else f"a_{c}") for c in anchors.columns if c != "held"])
    right = rows.select(*[F.col(c).alias("b" if c == "block" else f"b_{c}") for c in rows.columns if c != "held"])
    spark = rows.sparkSession

    def work(key, frame):
        row = frame.iloc[0]
        a_tags, _, a_labels, a_columns = _block(row, "a")
        b_tags, b_ids, b_labels, b_columns = _block(row, "b")
        if len(a_columns) != len(b_columns):
            raise ContractError("vectors of different lengths have no inner product")
        if "a_windows" in row:
            windows = np.frombuffer(row["a_windows"], np.int64).reshape(len(a_tags), -1, 3)
        else:
            windows = np.broadcast_to(np.array([[[0, -WIDE, WIDE]]]), (len(a_tags), 1, 3))
        vectors, columns = _exact(a_columns.T, b_columns)
        low, high = columns.min(1), columns.max(1)
        out = []
        for i, tag in enumerate(a_tags):
            alive = (b_labels == a_labels[i]) & (b_tags != tag) if same_label else b_labels != a_labels[i]
            own = windows[i][windows[i][:, 0] >= 0]
            found = scan(vectors[i], columns, low, high, alive, [tuple(w[1:].tolist()) for w in own], k, b_ids, b_tags)
            for place, (at, score) in zip(own[:, 0], found):
                if len(at):
                    out.append((np.full(len(at), tag), np.full(len(at), place), b_tags[at], b_ids[at], score.astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pd.DataFrame(dict(zip(("anchor", "place", "tag", "id", "score"), cols)))

    met = pairs.join(left, "a").join(right, "b")
    dealt = met.repartition(partitions(spark, pairs.count(), 4), "a", "b")
    return dealt.groupBy("a", "b").applyInPandas(work, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each anchor and window over all blocks; tasks keep k of each before the shuffle."""
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "id", "tag")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _floor_percent(value: Column) -> Column:
    """floor(value / 100) in whole numbers."""
    return ((value - F.pmod(value, F.lit(100))) / 100).cast("long")


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: id, label (long), v (array of ints), anchor (boolean). Scores are integer inner products. An anchor's
    positives are its first ``positives`` other rows of the same label. For each positive the first ``negatives`` rows of
    other labels whose score lies within ``least`` to ``most`` percent of the positive's are ranked from 1; higher
    scores come first and ties by smaller id. Searches are exact: all anchors against all rows, in blocks of columns.

    Repeated rows are rows of their own (a copy of an anchor is another row); an id of null comes last among ties. An
    anchor without positives, or a positive without rows inside its window, has no result; a negative positive score
    has an empty window. Labels need not be few. Empty input gives an empty result; vectors of different lengths, or
    scores beyond 2^53, are refused.
    """
    spark = rows.sparkSession
    known = F.coalesce(F.col("id"), F.lit(NO_ID)).alias("id")
    tagged = stored(rows.select(known, "label", "v", "anchor").withColumn("tag", F.monotonically_increasing_id()))
    size = min(max(-(-tagged.count() // (4 * spark.sparkContext.defaultParallelism)), ROWS[0]), ROWS[1])
    candidates = blocks(tagged.drop("anchor"), size)
    anchors = tagged.where("anchor").drop("anchor")

    first = blocks(anchors, ANCHORS)
    by_label = lambda df, name: df.select(F.col("block").alias(name), F.explode("held").alias("label"))
    meet = by_label(first, "a").join(by_label(candidates, "b"), "label").select("a", "b").distinct()
    best = stored(_first(scan_pairs(first, candidates, meet, positives, True), positives).select(
        "anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        (-_floor_percent(F.col("score") * -least)).alias("least"), _floor_percent(F.col("score") * most).alias("most")))

    open_windows = best.where("least <= most").groupBy("anchor").agg(F.collect_list(F.struct("place", "least", "most")).alias("windows"))
    second = blocks(anchors.join(open_windows, F.col("tag") == F.col("anchor")).drop("anchor"), ANCHORS, True)
    # Blocks of one label each, and of the same one, hold no pair of different labels.
    one = F.size("a_held") + F.size("b_held") == 2
    count = candidates.count()
    every = second.select(F.col("block").alias("a"), F.col("held").alias("a_held"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("b")) \
        if count else second.select(F.col("block").alias("a"), F.col("held").alias("a_held"), F.lit(0).alias("b")).limit(0)
    meet = every.withColumn("b", F.col("b").cast("long")).join(candidates.select(F.col("block").alias("b"), F.col("held").alias("b_held")), "b").where(
        ~(one & (F.col("a_held")[0] == F.col("b_held")[0]))).select("a", "b")
    found = _first(scan_pairs(second, candidates, meet, negatives, False), negatives)
    given = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    named = anchors.select(F.col("tag").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(best.drop("least", "most"), ["anchor", "place"]).join(named, "anchor").select(
        "anchor_id", given("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), given("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def mine(embeddings: DataFrame, scale: int = 256, every: int = 100, shifted: int = 7, labels: int = 10, id_col="vec_id",
         vector_col="embedding", label_col="label", **limits) -> DataFrame:
    """:func:`hard_negatives` of an embeddings table: entries become floor(scale * x), anchors are the ids divisible by
    ``every``, and the label of ids divisible by ``shifted`` moves on by one of ``labels``.

    Rows with a null label, a null vector, or a null or non-finite entry take no part; other columns are not read.
    """
    given = F.col(id_col).cast("long")
    label = F.col(label_col).cast("long")
    moved = F.when(given % shifted == 0, (label + 1) % labels).otherwise(label)
    rows = embeddings.select(given.alias("id"), moved.alias("label"), integer_vector(F.col(vector_col), scale).alias("v"),
                             F.coalesce(given % every == 0, F.lit(False)).alias("anchor"))
    return hard_negatives(rows.where("label IS NOT NULL AND v IS NOT NULL"), **limits)
