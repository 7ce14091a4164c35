"""Exact nearest neighbours by a metric index: pivots, rings around them, and bounds from the triangle inequality."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ranks import ordered_positions
from ..functions.windows import md5_order
from ..session import stored
from .blocks import COLUMNS, ROWS, block_count, exact, from_bytes, numbers, paired, squares, to_bytes, vectors

PIVOTS = 512        # at most; with one vector each they are the only points that every task sees
SLACK = 1e-9        # relative; a bound that rounding lowers by less than this visits one block more
NONE = np.iinfo(np.int64).max

PACKED = "block int, n int, z binary, own binary, pivot binary, away binary, near binary, other binary, reach binary, ring binary, visited long"
SUMMARY = ("start", "pivot", "low", "high", "reach")


class Side:
    """A block's points (vectors, numbers in order of id), its rings, and the ``k`` best found so far for each point."""

    def __init__(self, z, own, k, reach=None):
        self.z, self.own, self.k = z, own, k
        self.near, self.other = np.full((len(z), k), np.inf), np.full((len(z), k), NONE)
        self.reach = np.full(len(z), np.inf) if reach is None else reach

    def update(self, at, distance, other):
        """Merge candidates into the best ones: by distance, then by the other point's number."""
        rows = np.unique(at)
        at = np.concatenate([at, np.repeat(rows, self.k)])
        distance = np.concatenate([distance, self.near[rows].ravel()])
        other = np.concatenate([other, self.other[rows].ravel()])
        order = np.lexsort((other, distance, at))
        at, distance, other = at[order], distance[order], other[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = rank < self.k
        self.near[at[kept], rank[kept]], self.other[at[kept], rank[kept]] = distance[kept], other[kept]
        self.reach[rows] = np.minimum(self.reach[rows], self.near[rows, -1])


def _limit(reach, error):
    """The greatest computed square that a distance within reach can have."""
    return reach * reach * (1 + SLACK) + error


def _first_reach(side):
    """An upper bound of each point's k-th distance: from the points stored around it."""
    left, right, error = squares(side.z, side.z)
    n = len(side.z)
    if n <= side.k:
        return
    for r in range(0, n, ROWS):
        low = max(0, min(r, n - ROWS))
        d = left[r:r + ROWS] @ right[low:low + ROWS].T
        kth = np.partition(d, side.k, axis=1)[:, side.k]  # the point itself is among them
        off = error * (left[r:r + ROWS, -2] + right[low:low + ROWS, -1].max())
        side.reach[r:r + ROWS] = np.sqrt(np.maximum(kth, 0) + off) * (1 + SLACK)


def _rings(pivot, away, position, tile):
    """Where a block's rings begin: another pivot, or ``tile`` positions of the whole order on."""
    cut = position // tile
    return np.flatnonzero(np.r_[True, (pivot[1:] != pivot[:-1]) | (cut[1:] != cut[:-1])])


def _close(a, b, apart):
    """Pairs of rings whose least possible distance is inside the reach of a point on either side."""
    d = apart[a["pivot"]][:, b["pivot"]]
    al, ah, bl, bh = a["low"][:, None], a["high"][:, None], b["low"], b["high"]
    least = np.maximum.reduce([d - ah - bh, al - d - bh, bl - d - ah, np.zeros_like(d)])
    return least <= np.maximum(a["reach"][:, None], b["reach"]) * (1 + SLACK) + SLACK * (d + ah + bh)


def _search(a, b, start_a, start_b, close, same):
    """Compare the points of close rings; what may be within reach of either point is measured exactly and kept for both."""
    (left, right, error), (na, nb) = squares(a.z, b.z), ((a.z * a.z).sum(1), (b.z * b.z).sum(1))
    ends, width = np.r_[start_a[1:], len(a.z)], np.diff(np.r_[start_b, len(b.z)])
    room = np.empty((ROWS, COLUMNS))
    first = 0
    while first < len(start_a):  # rings together up to ROWS points; a longer one in pieces
        last = max(first + 1, int(np.searchsorted(ends, start_a[first] + ROWS, "right")))
        columns = np.flatnonzero(np.repeat(close[first:last].any(0), width))
        for r in range(start_a[first], ends[last - 1], ROWS):
            rows = slice(r, min(r + ROWS, ends[last - 1]))
            for c in range(0, len(columns), COLUMNS):
                cols = columns[c:c + COLUMNS]
                if cols[-1] - cols[0] + 1 == len(cols):
                    cols = slice(cols[0], cols[-1] + 1)
                them = right[cols]
                d = np.matmul(left[rows], them.T, out=room[:rows.stop - rows.start, :len(them)])
                off = error * (na[rows].max() + nb[cols].max())
                hit = (d <= _limit(a.reach[rows], off)[:, None]) | (d <= _limit(b.reach[cols], off))
                x, y = np.nonzero(hit)
                x, y = x + r, (y + cols.start if isinstance(cols, slice) else cols[y])
                if same:
                    x, y = x[y > x], y[y > x]
                if not len(x):
                    continue
                far = exact(a.z, b.z, x, y)
                for side, at, other in ((a, x, b.own[y]), (b, y, a.own[x])):
                    kept = far <= side.reach[at] * (1 + SLACK)
                    if kept.any():
                        side.update(at[kept], far[kept], other[kept])
        first = last


def _summary(cells):
    """Rings from their packed form: one row of numbers for each."""
    ring = numbers(cells).reshape(-1, len(SUMMARY))
    return {name: ring[:, i].astype(int) if name in ("start", "pivot") else ring[:, i] for i, name in enumerate(SUMMARY)}


def _found(side):
    """The candidates of a block's points as rows."""
    i, j = np.nonzero(np.isfinite(side.near))
    return {"own": side.own[i], "distance": side.near[i, j], "other": side.other[i, j]}


def _ringed(points: DataFrame, tile: int, k: int):
    """(names, blocks, pivots, number of blocks): points in order of the nearest pivot and of the distance to it.

    A ring holds at most ``tile`` consecutive points of one pivot, a block consecutive rings. Positions come from one
    distributed order, so a pivot with most of the points fills many rings and no task orders a pivot's points alone. Each
    block is searched for neighbours within itself while it is packed.
    """
    rows = points.select(F.col("id").cast("string").alias("id"), F.col("z").cast("array<double>").alias("z"), "label")
    count, number = block_count(rows, max(tile, 512))
    wanted = max(1, min(PIVOTS, count // tile))
    pivots = np.array([r["z"] for r in rows.orderBy(md5_order(F.lit(11), "id"), "id").limit(wanted).select("z").collect()], float)
    apart = np.stack([np.sqrt(((pivots - p) ** 2).sum(1)) for p in pivots]) if len(pivots) else np.zeros((0, 0))
    numbered = ordered_positions(rows, "id", "id", "own").drop("size")

    def assign(frames):
        for frame in frames:
            z = np.array(frame["z"].tolist(), float)
            d = np.stack([np.sqrt(((pivots - row) ** 2).sum(1)) for row in z])
            near = d.argmin(1)
            yield frame.assign(pivot=near.astype("int32"), away=d[np.arange(len(z)), near])

    placed = numbered.select("own", "z").mapInPandas(assign, "own long, z array<double>, pivot int, away double")
    ordered = ordered_positions(placed.withColumn("place", F.struct("pivot", "away")), "place", "own")

    def pack(table):
        table = table.sort_by("position")
        pivot, away, own, position = (table[c].to_numpy() for c in ("pivot", "away", "own", "position"))
        side = Side(vectors(table["z"]), own, k)
        start = _rings(pivot, away, position, tile)
        _first_reach(side)
        ends = np.r_[start[1:], len(own)] - 1
        ring = {"start": start, "pivot": pivot[start], "low": away[start], "high": away[ends], "reach": np.maximum.reduceat(side.reach, start)}
        close = np.triu(_close(ring, ring, apart))
        np.fill_diagonal(close, True)
        _search(side, side, start, start, close, True)
        ring["reach"] = np.maximum.reduceat(side.reach, start)
        cells = {"own": own, "pivot": pivot, "away": away, "near": side.near, "other": side.other, "reach": side.near[:, -1],
                 "ring": np.stack([np.asarray(ring[c], float) for c in SUMMARY], 1)}
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "n": pa.array([len(own)], pa.int32()), "z": pa.array([to_bytes(side.z)], pa.binary()),
                         **{name: pa.array([cell.tobytes()], pa.binary()) for name, cell in cells.items()}, "visited": [int(close.sum())]})

    dealt = ordered.withColumn("block", F.floor(F.col("position") * number / F.col("size")).cast("int")).drop("place", "size")
    return numbered.select("own", "id", "label"), stored(dealt.repartition(number, "block").groupBy("block").applyInArrow(pack, PACKED)), apart, number


def nearest_neighbours(points: DataFrame, k=5, tile=512):
    """(rows, visits): the ``k`` nearest other points of every point, and how many pairs of rings were compared.

    ``rows``: id, label, rank, other, other_label, distance; ties go to the smaller id, ids compare as text and are
    unique. Each block is first searched within itself, which bounds how far a point has to look. Then come the pairs of
    blocks with rings whose least possible distance, from pivot distances and ring ends, is inside the reach of a point on
    either side; inside a pair only such rings meet, each pair computed once for both. Products of vectors tell which pairs
    of points may be within reach, and only their distances are measured. ``visits`` has one row: blocks (rings),
    all_pairs, visited_pairs.
    """
    names, blocks, apart, number = _ringed(points, tile, k)

    def reachable(batches):
        for batch in batches:
            kept = [_close(_summary(a), _summary(b), apart).any() for a, b in zip(batch["a_ring"], batch["b_ring"])]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    ends = lambda p: blocks.select(F.col("block").alias(p), F.col("ring").alias(f"{p}_ring"))
    far = ends("a").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).where("b > a").join(ends("b"), "b")
    pairs = far.select("a", "b", "a_ring", "b_ring").mapInArrow(reachable, "a int, b int")
    partners = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("block"), F.col("b").alias("_other")),
                                              F.struct(F.col("b").alias("block"), F.col("a").alias("_other")))).alias("p")).select("p.*")
    loaded = blocks.select("block", "z", "own", "reach", "ring").join(
        partners.groupBy("block").agg(F.collect_list("_other").alias("_others")), "block")  # at most one entry per block

    def across(table):
        sides, rings = [], []
        for at in np.argsort(table["block"].to_numpy()).tolist():
            own = numbers(table["own"][at], np.int64)
            sides.append(Side(from_bytes(table["z"][at], len(own)), own, k, numbers(table["reach"][at])))
            rings.append(_summary(table["ring"][at]))
        close = _close(*rings, apart)
        _search(*sides, rings[0]["start"], rings[1]["start"], close, False)
        parts = [_found(side) for side in sides] + [{"own": np.array([-1]), "distance": np.array([0.0]), "other": np.array([close.sum()])}]
        return pa.table({c: np.concatenate([p[c] for p in parts]) for c in ("own", "distance", "other")})

    def within(batches):
        for batch in batches:
            for own, near, other in zip(batch["own"], batch["near"], batch["other"]):
                side = Side(np.empty((0, 0)), numbers(own, np.int64), k)
                side.near, side.other = numbers(near).reshape(-1, k), numbers(other, np.int64).reshape(-1, k)
                yield pa.RecordBatch.from_pydict(_found(side))

    shape = "own long, distance double, other long"
    # Rows of pair visits carry the number -1.
    met = paired(loaded, number * (number - 1) // 2, F.col("_others")).drop("_others")
    second = stored(met.groupBy("i", "j").applyInArrow(across, shape))
    first = blocks.select("own", "near", "other").mapInArrow(within, shape)
    order = Window.partitionBy("own").orderBy("distance", "other")
    best = first.unionByName(second.where("own >= 0")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    others = names.select(F.col("own").alias("other"), F.col("id").alias("_id"), F.col("label").alias("other_label"))
    rows = best.join(names, "own").join(others, "other").select("id", "label", "rank", F.col("_id").alias("other"), "other_label", "distance")
    across_blocks = second.where("own < 0").agg(F.coalesce(F.sum("other"), F.lit(0))).scalar()
    rings = F.octet_length("ring") / (8 * len(SUMMARY))
    visits = blocks.agg(F.coalesce(F.sum(rings), F.lit(0)).cast("long").alias("blocks"), F.coalesce(F.sum("visited"), F.lit(0)).alias("_v")).select(
        "blocks", (F.col("blocks") * (F.col("blocks") + 1) / 2).cast("long").alias("all_pairs"), (F.col("_v") + across_blocks).alias("visited_pairs"))
    return rows, visits
