"""Low-dimensional series representations: splits, scaling, PCA completion, agreement metrics.

Points are (id, z ARRAY<DOUBLE>, label) rows; matrices are long (id, pos, value).
"""
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checks import ContractError
from ..functions.windows import hash_sample, md5_order
from ..session import durable, stored
from .blocks import COLUMNS, ROWS, block_count, exact, from_bytes, numbers, paired, squares, to_bytes, vectors
from .clusters import agglomerate
from .neighbours import nearest_neighbours
from .recurrence import held_out
from .stability import bounded_rank_agreement
from .subspace import leading_directions


def hold_out(series: DataFrame, status="status", key="series", share=5, minimum=10) -> DataFrame:
    """Hash split of fully observed series; imputed ones only train.

    With fewer than ``minimum`` observed series nobody is held out.
    """
    tagged = held_out(series, key, share)
    observed = series.where(F.col(status) == "observed").agg(F.count("*")).scalar()
    eligible = F.col(status) == "observed"
    return tagged.withColumn("_n", observed).withColumn(
        "held_out", F.col("held_out") & eligible & (F.col("_n") >= minimum)).drop("_n")


def sub_sample(ids: DataFrame, n: int, key="series", seed=7) -> DataFrame:
    """At most ``n`` ids in hash order (take-ordered: every task keeps n rows at most)."""
    return ids.orderBy(md5_order(F.lit(seed), key), key).limit(n)


def column_scale(matrix: DataFrame) -> DataFrame:
    """Mean and population deviation per position over training rows; a flat column keeps scale 1."""
    sd = F.stddev_pop("value")
    return matrix.groupBy("pos").agg(F.avg("value").alias("mean"), F.when(sd <= 1e-12, 1.0).otherwise(sd).alias("scale"))


def standardise(matrix: DataFrame, scale: DataFrame) -> DataFrame:
    return matrix.join(scale, "pos").select("id", "pos", ((F.col("value") - F.col("mean")) / F.col("scale")).alias("value"))


def unstandardise(matrix: DataFrame, scale: DataFrame) -> DataFrame:
    return matrix.join(scale, "pos").select("id", "pos", (F.col("value") * F.col("scale") + F.col("mean")).alias("value"))


def principal_components(train: DataFrame, k=2, **options) -> DataFrame:
    """Components (pos, c1..ck) of a standardised training matrix, by the range finder of ``subspace``.

    Each component's largest loading is positive. A matrix of lower rank gives fewer components.
    """
    found, sizes = leading_directions(train, k, **options)
    return found.select("pos", *[F.get("c", F.lit(j)).alias(f"c{j + 1}") for j in range(len(sizes))])


def _axes(components: DataFrame) -> list:
    return [c for c in components.columns if c != "pos"]


def coordinates(matrix: DataFrame, components: DataFrame, observed=None) -> DataFrame:
    """Least-squares coordinates (id, z1..zk) on the components from the observed positions only.

    The k x k normal equations are grouped sums; each row solves its own, with the smallest solution where the observed
    positions leave some direction open.
    """
    axes = _axes(components)
    k = len(axes)
    rows = matrix.join(components, "pos")
    if observed is not None:
        rows = rows.where(F.col("pos").isin(list(observed)) if not isinstance(observed, Column) else observed)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.groupBy("id").agg(*[F.sum(F.col(axes[i]) * F.col(axes[j])).alias(f"m{i}_{j}") for i, j in pairs],
                                  *[F.sum(F.col(c) * F.col("value")).alias(f"t{i}") for i, c in enumerate(axes)])

    def solve(frames):
        for frame in frames:
            m, t = np.zeros((len(frame), k, k)), np.zeros((len(frame), k, 1))
            for i, j in pairs:
                m[:, i, j] = m[:, j, i] = frame[f"m{i}_{j}"]
            for i in range(k):
                t[:, i, 0] = frame[f"t{i}"]
            z = (np.linalg.pinv(m, rcond=1e-12, hermitian=True) @ t)[:, :, 0]
            yield pd.DataFrame({"id": frame["id"], **{f"z{i + 1}": z[:, i] for i in range(k)}})
    kind = matrix.schema["id"].dataType.simpleString()
    return sums.mapInPandas(solve, f"id {kind}, " + ", ".join(f"z{i + 1} double" for i in range(k)))


def decode(points: DataFrame, components: DataFrame, cells: DataFrame) -> DataFrame:
    """The points' values (id, pos, value) at the given cells (id, pos): both sides come by a join on their own key."""
    total = sum((F.col(f"z{i + 1}") * F.col(c) for i, c in enumerate(_axes(components))), F.lit(0.0))
    return cells.select("id", "pos").join(components, "pos").join(points, "id").select("id", "pos", total.alias("value"))


def completion(train: DataFrame, test: DataFrame, observed_pos, k=2) -> dict:
    """PCA completion of withheld positions of held-out rows; nothing of them enters the fit."""
    scale = column_scale(train)
    strain, stest = durable(standardise(train, scale)), standardise(test, scale)
    components = principal_components(strain, k)
    z = coordinates(strain, components)
    ztest = coordinates(stest, components, observed_pos)
    return {"scale": scale, "components": components, "train": strain, "test": stest, "latent": z, "test_latent": ztest,
            "reconstruction": decode(z, components, strain), "prediction": decode(ztest, components, stest)}


def completion_scores(actual_train, reconstruction, actual_test, prediction, scale, withheld: Column, model="pca") -> DataFrame:
    """Training error, withheld error (standardised) and withheld RMSE in source units: one row."""
    err = lambda a, p: a.join(p.withColumnRenamed("value", "_p"), ["id", "pos"])
    e = F.col("_p") - F.col("value")
    tr = err(actual_train, reconstruction).agg(F.avg(e * e)).scalar()
    te = err(actual_test, prediction).join(scale, "pos").where(withheld)
    raw = e * F.col("scale")
    return te.agg(F.avg(e * e).alias("withheld_mse_standardised"), F.sqrt(F.avg(raw * raw)).alias("withheld_rmse_source_units")).withColumns(
        {"train_mse_standardised": tr, "model": F.lit(model)})


TILE = 512


def distances_by_label(points: DataFrame, tile=TILE) -> DataFrame:
    """Per point and label: summed distance to that label's points, and their number (the point itself included).

    Blocks hold their points in order of the label, so a label's share of a row of distances is one run. Distances come
    from products of blocks; those that rounding could touch, because they are small beside the vectors, are taken from the
    differences. A pair of blocks leaves one array per block and label, and arrays of a block add up.
    """
    rows = points.select(F.col("id").cast("string").alias("id"), F.col("z").cast("array<double>").alias("z"), "label")
    _, count = block_count(rows, tile)

    def pack(table):
        table = table.sort_by([("label", "ascending")])  # NULL labels come last
        return pa.table({"block": table["block"][:1], "ids": pa.array([table["id"].to_pylist()], pa.list_(pa.string())),
                         "labels": pa.array([table["label"].to_pylist()], pa.list_(pa.int32())), "z": [to_bytes(vectors(table["z"]))]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).repartition(count, "block")
    blocks = stored(dealt.groupBy("block").applyInArrow(pack, "block int, ids array<string>, labels array<int>, z binary"))

    def side(table, row):
        labels = table["labels"][row].as_py()
        runs = {lab: at for at, lab in reversed(list(enumerate(labels))) if lab is not None}  # each label's first place
        return from_bytes(table["z"][row], len(labels)), list(runs)[::-1], np.array(list(runs.values())[::-1], int), sum(
            lab is not None for lab in labels)

    def work(table):
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        if i != j and len(table) == 1:  # the hash left the other block empty
            return parts.slice(0, 0)
        at = {b: row for row, b in enumerate(table["block"].to_pylist())}
        (za, la, sa, ka), (zb, lb, sb, kb) = side(table, at[i]), side(table, at[j])
        shift = za.mean(0)
        left, right, _ = squares(za - shift, zb - shift)
        to_a, to_b = np.zeros((len(lb), len(za))), np.zeros((len(la), len(zb)))
        room = np.empty((min(ROWS, len(za)), len(zb)))
        na, nb = left[:, -2], right[:, -1]
        for r in range(0, len(za), ROWS):
            full = room[:len(za[r:r + ROWS])]
            for c in range(0, len(zb), COLUMNS):
                d = full[:, c:c + COLUMNS]
                np.matmul(left[r:r + ROWS], right[c:c + COLUMNS].T, out=d)
                x, y = np.nonzero(d < 1e-5 * (na[r:r + ROWS, None] + nb[c:c + COLUMNS].max()))
                small = d[x, y] < 1e-5 * (na[x + r] + nb[y + c])
                x, y = x[small], y[small]
                d[x, y] = 0.0
                np.sqrt(d, out=d)
                d[x, y] = exact(za, zb, x + r, y + c)
            if len(lb):
                to_a[:, r:r + ROWS] = np.add.reduceat(full[:, :kb], sb, axis=1).T
            if i != j:
                for lab in range(len(la)):
                    lo, hi = max(sa[lab], r), min(sa[lab + 1] if lab + 1 < len(la) else ka, r + ROWS)
                    if lo < hi:
                        to_b[lab] += full[lo - r:hi - r].sum(0)
        out = [(i, lab, to_a[m].tobytes()) for m, lab in enumerate(lb)]
        out += [(j, lab, to_b[m].tobytes()) for m, lab in enumerate(la)] if i != j else []
        return pa.table({name: pa.array([o[m] for o in out], kind) for m, (name, kind) in enumerate(zip(parts.column_names, parts.schema.types))})

    def add(table):
        total = sum(numbers(cell) for cell in table["totals"])
        return pa.table({"block": table["block"][:1], "other": table["other"][:1], "totals": [total.tobytes()]})

    def unpack(frames):
        for frame in frames:
            for r in frame.itertuples():
                yield pd.DataFrame({"id": list(r.ids), "label": pd.array(list(r.labels), "Int32"), "other": r.other, "total": np.frombuffer(r.totals)})

    parts = pa.table({"block": pa.array([], pa.int32()), "other": pa.array([], pa.int32()), "totals": pa.array([], pa.binary())})
    shape = "block int, other int, totals binary"
    met = paired(blocks.select("block", "labels", "z"), count * (count + 1) // 2, F.sequence(F.lit(0), F.lit(count - 1)))
    sums = met.groupBy("i", "j").applyInArrow(work, shape).groupBy("block", "other").applyInArrow(add, shape)
    found = sums.join(blocks.select("block", "ids", "labels"), "block").select("ids", "labels", "other", "totals").mapInPandas(
        unpack, "id string, label int, other int, total double")
    sizes = rows.groupBy(F.col("label").alias("other")).agg(F.count("*").alias("n"))
    return found.join(sizes, "other").select("id", "label", "other", "total", "n")


def silhouette(points: DataFrame, tile=TILE) -> DataFrame:
    """Mean silhouette with Euclidean distance; a point alone in its label scores 0."""
    d = distances_by_label(points, tile)
    same = F.col("label") == F.col("other")
    per = d.groupBy("id").agg(
        F.max(F.when(same, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"), F.max(F.when(same, F.col("n"))).alias("own"))
    s = F.when(F.col("own") == 1, 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return per.agg(F.avg(F.coalesce(s, F.lit(0.0))).alias("silhouette"))


def _exploded(points):
    return points.select("id", "label", F.posexplode("z").alias("axis", "x"))


def centroid_scores(points: DataFrame) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz indexes from centroid aggregates."""
    size = points.groupBy("label").agg(F.count("*").alias("n"))
    center = _exploded(points).groupBy("label", "axis").agg(F.avg("x").alias("m"))
    packed = center.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "m"))), lambda p: p["m"]).alias("c"))
    packed = packed.join(size, "label")
    overall = _exploded(points).groupBy("axis").agg(F.avg("x").alias("m")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("axis", "m"))), lambda p: p["m"])).scalar()
    gap2 = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    sq = gap2(F.col("z").cast("array<double>"), F.col("c"))
    inner = points.join(packed.select("label", "c"), "label").withColumn("_d2", sq).groupBy("label").agg(
        F.sum("_d2").alias("within"), F.avg(F.sqrt("_d2")).alias("spread"))
    # One row per label from here on: labels are classes, two in the study, and number is checked by the caller's label type.
    table = packed.join(inner, "label").withColumn("overall", overall)
    ch = table.agg(F.sum(F.col("n") * gap2(F.col("c"), F.col("overall"))).alias("between"), F.sum("within").alias("within"),
                   F.count("*").alias("k"), F.sum("n").alias("n"))
    every = table.agg(F.collect_list(F.struct("label", "c", "spread"))).scalar()
    ratio = lambda o: F.try_divide(F.col("spread") + o["spread"], F.nullif(F.sqrt(gap2(F.col("c"), o["c"])), F.lit(0.0)))
    worst = F.array_max(F.transform(F.filter("_all", lambda o: o["label"] != F.col("label")), ratio))
    db = table.withColumn("_all", every).select(worst.alias("w")).agg(F.avg("w")).scalar()
    return ch.select(F.try_divide(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1)).alias(
        "calinski_harabasz")).withColumn("davies_bouldin", db)


def nearest_label_agreement(points: DataFrame, k=5, tile=TILE) -> DataFrame:
    """Mean share of the ``k`` nearest other points that carry a point's label. Ties go to the smaller id."""
    near = nearest_neighbours(points, k, tile)[0]
    share = F.avg((F.col("other_label") == F.col("label")).cast("double"))
    return near.groupBy("id").agg(share.alias("s")).agg(F.avg("s").alias("knn_label_agreement"))


def latent_metrics(points: DataFrame) -> DataFrame:
    """All descriptive scores in one row; NULL when there is one class or one point per class."""
    shape = points.agg(F.count_distinct("label").alias("k"), F.count("*").alias("n"))
    out = shape.withColumn("silhouette", silhouette(points).scalar())
    c = centroid_scores(points)
    out = out.withColumns({"davies_bouldin": c.select("davies_bouldin").scalar(), "calinski_harabasz": c.select("calinski_harabasz").scalar(),
                           "knn_label_agreement": nearest_label_agreement(points).scalar()})
    ok = (F.col("k") > 1) & (F.col("k") < F.col("n"))
    return out.select(*[F.when(ok, F.col(m)).alias(m) for m in ("silhouette", "davies_bouldin", "calinski_harabasz")], "knn_label_agreement")


PAIR_ROWS, BUCKET = 2048, 2_000_000
PACKED_PAIRS = 2 ** 23  # 0.3 GB of disk


def _bucketed(cuts, values):
    """Odd buckets hold one value (a cut point), even ones the values between."""
    below = np.searchsorted(cuts, values)
    return 2 * below + (cuts[np.minimum(below, len(cuts) - 1)] == values)


def _runs(order_by):
    """(order, [(key, from, to)]) of equal keys."""
    order = np.argsort(order_by, kind="stable")
    keys, starts = np.unique(order_by[order], return_index=True)
    return order, list(zip(keys.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]))


def _local_ranks(bucket, values):
    """Average ranks inside a bucket, from 1; 0 where all its values are one, as the bucket's total tells the rank."""
    if bucket % 2:
        return np.zeros(len(values))
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def distance_stability(first: DataFrame, second: DataFrame, tile=TILE, digits=6) -> DataFrame:
    """Rank agreement of two embeddings' distances (id, z in both); NULL when either is constant.

    The statistic's sample is the set of distances itself, so the arithmetic grows with the square of the number of *series*.
    Up to ``PACKED_PAIRS`` pairs are ranked one by one. Beyond, no pair is kept (``stability``): the result is bounded from
    both sides until its rounding to ``digits`` decimal places is certain; pairs are ranked one by one if it never is.
    """
    both = first.select("id", F.col("z").alias("p")).join(second.select("id", F.col("z").alias("q")), "id")
    width = both.agg(F.coalesce(F.max(F.size("p")), F.lit(0))).first()[0]
    rows = both.select("id", F.concat(F.col("p").cast("array<double>"), F.col("q").cast("array<double>")).alias("z"))
    n, count = block_count(rows, tile)
    if n * (n - 1) // 2 > PACKED_PAIRS:
        rows = stored(rows)
        value = bounded_rank_agreement(rows, n, width, digits, tile)
        if value is not None:
            result = F.lit(None if math.isnan(value) else value).cast("double")
            return rows.sparkSession.range(1).select(F.lit(n * (n - 1) // 2).cast("long").alias("n_paired"), result.alias("distance_rank_stability"))
    return _packed_stability(rows, n, width, max(count, -(-n // PAIR_ROWS)))


def _packed_stability(rows, n, width, count):
    """Rank agreement with every pair ranked: 32 bytes of disk for each.

    Pairs of blocks leave packed distances, dealt by buckets of the first one; there they get their rank inside the bucket
    and are dealt by buckets of the second one, where sums of products are left. A rank is the bucket's offset plus the
    rank inside, so offsets enter the sums at the end. Cut points come from a sample; ranks are exact whatever they are,
    and a value that fills a bucket is a bucket of its own, in as many parts as there were pairs of blocks.
    """
    seen = np.array([r["z"] for r in rows.orderBy(md5_order(F.lit(5), "id"), "id").limit(1000).select("z").collect()], float)

    def distances(za, zb, same):
        x, y = np.full((len(za), len(zb)), np.nan), np.full((len(za), len(zb)), np.nan)
        for i, row in enumerate(za):
            lo = i + 1 if same else 0
            diff = (zb[lo:] - row) ** 2
            x[i, lo:], y[i, lo:] = np.sqrt(diff[:, :width].sum(1)), np.sqrt(diff[:, width:].sum(1))
        known = np.triu(np.ones(x.shape, bool), 1) if same else np.ones(x.shape, bool)
        return x[known], y[known]

    shares = np.linspace(0, 1, max(8, n * (n - 1) // 2 // BUCKET) + 1)
    cut_x, cut_y = [np.unique(np.quantile(v, shares, method="nearest")) for v in distances(seen, seen, True)] if n > 1 else [np.zeros(1)] * 2

    def pack(table):
        return pa.table({"block": table["block"][:1], "n": pa.array([len(table)], pa.int32()), "z": [vectors(table["z"]).tobytes()]})

    def packed(out, shape):
        return pa.table({name: pa.array([o[m] for o in out], kind) for m, (name, kind) in enumerate(shape)})

    def by_first(table):
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        blocks = dict(zip(table["block"].to_pylist(), [numbers(z).reshape(k, -1) for z, k in zip(table["z"], table["n"].to_pylist())]))
        x, y = distances(blocks[i], blocks[j], i == j) if len(blocks) == 1 + (i != j) else (np.zeros(0), np.zeros(0))
        order, runs = _runs(_bucketed(cut_x, x))
        x, y = x[order], y[order]
        return packed([(bx, i * count + j if bx % 2 else 0, x[lo:hi].tobytes(), y[lo:hi].tobytes()) for bx, lo, hi in runs],
                      [("bx", pa.int32()), ("part", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])

    def by_second(table):
        bx, part = table["bx"][0].as_py(), table["part"][0].as_py()
        x, y = [np.concatenate([numbers(cell) for cell in table[c]]) for c in "xy"]
        order, runs = _runs(_bucketed(cut_y, y))
        ranks, y = _local_ranks(bx, x)[order], y[order]
        return packed([(bx, by, bx * count * count + part if by % 2 else 0, ranks[lo:hi].tobytes(), y[lo:hi].tobytes()) for by, lo, hi in runs],
                      [("bx", pa.int32()), ("by", pa.int32()), ("part", pa.int64()), ("r", pa.binary()), ("y", pa.binary())])

    def sums(table):
        by = table["by"][0].as_py()
        r, y = [[numbers(cell) for cell in table[c]] for c in "ry"]
        bx = np.repeat(table["bx"].to_numpy(), [len(v) for v in r])
        r, s = np.concatenate(r), _local_ranks(by, np.concatenate(y))
        order, runs = _runs(bx)
        r, s = r[order], s[order]
        parts = [(x, by, hi - lo, *[float(v[lo:hi].sum()) for v in (r, s, r * r, s * s, r * s)]) for x, lo, hi in runs]
        return packed(parts, [("bx", pa.int32()), ("by", pa.int32()), ("n", pa.int64())] + [(c, pa.float64()) for c in ("r", "s", "rr", "ss", "rs")])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    blocks = stored(dealt.groupBy("block").applyInArrow(pack, "block int, n int, z binary"))
    met = paired(blocks, count * (count + 1) // 2, F.sequence(F.lit(0), F.lit(count - 1)))
    table = met.groupBy("i", "j").applyInArrow(by_first, "bx int, part long, x binary, y binary")
    table = table.repartition(2 * len(cut_x) + 1, "bx", "part").groupBy("bx", "part").applyInArrow(
        by_second, "bx int, by int, part long, r binary, y binary")
    table = stored(table.repartition(2 * len(cut_y) + 1, "by", "part").groupBy("by", "part").applyInArrow(
        sums, "bx int, by int, n long, r double, s double, rr double, ss double, rs double"))

    def offsets(bucket, out):
        total = table.groupBy(bucket).agg(F.sum("n").alias("_t"))
        seq = Window.partitionBy(F.lit(0)).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # two rows per cut point at most
        below = F.coalesce(F.sum("_t").over(seq), F.lit(0))
        return total.select(bucket, (below + F.when(F.col(bucket) % 2 == 1, (F.col("_t") + 1) / 2).otherwise(0.0)).alias(out))

    u, v = [F.col(c) - F.lit((n * (n - 1) // 2 + 1) / 2) for c in ("_x", "_y")]  # from the mean rank
    m = F.col("n")
    moments = table.join(offsets("bx", "_x"), "bx").join(offsets("by", "_y"), "by").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_paired"), F.sum(m * u * u + 2 * u * F.col("r") + F.col("rr")).alias("xx"),
        F.sum(m * v * v + 2 * v * F.col("s") + F.col("ss")).alias("yy"),
        F.sum(m * u * v + u * F.col("s") + v * F.col("r") + F.col("rs")).alias("xy"))
    varies = (F.col("n_paired") >= 3) & (F.col("xx") > 0) & (F.col("yy") > 0)
    return moments.select("n_paired", F.when(varies, F.col("xy") / F.sqrt("xx") / F.sqrt("yy")).alias("distance_rank_stability"))


def two_way_clusters(points: DataFrame, weight=None) -> DataFrame:
    """Two clusters of coordinates by Ward's agglomeration."""
    return agglomerate(points, 2, weight)


def marginal_members(points: DataFrame, ranges: dict, per_region=2, seed=7) -> DataFrame:
    """Points inside each named coordinate range (open bounds), and two hash-picked members of each.

    ``ranges`` maps a name to (axis, low, high).
    """
    regions = F.array(*[F.struct(F.lit(n).alias("region"), F.lit(a).alias("axis"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
                        for n, (a, lo, hi) in ranges.items()])
    rows = points.withColumn("r", F.explode(regions)).withColumn("x", F.get("z", F.col("r.axis"))).where(
        (F.col("x") > F.col("r.lo")) & (F.col("x") < F.col("r.hi")))
    inside = rows.select(F.col("r.region").alias("region"), "id")
    return hash_sample(inside, ["region"], per_region, md5_order(F.lit(seed), "region", "id"))


def comparison(results) -> DataFrame:
    """One table of the models' one-row results."""
    out = None
    for df in results:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ContractError("Nothing to compare")
    return out
