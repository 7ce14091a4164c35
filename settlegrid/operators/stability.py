"""Rank agreement of all distances of two embeddings, without a row, a byte or a shuffle per pair.

Ranks of all pairs cannot be had exactly unless the pairs are kept: 32 bytes of disk for each. What is asked for, a correlation
to some decimal places, can: it is bounded from below and above, and given out only if both bounds round alike.

A first pass counts the distances in some ten thousand cells, which gives every distance a rough rank. Then each task takes one
slice of the ranks of either side: it meets all pairs of points, keeps to the distances of its slice and counts them in millions
of bins, each with the sum of the other side's rough ranks. A bin's mean rank is exact. What is left open is the product of both
sides' roughness, and the ranks inside bins of several values; both are bounded by their sums of squares (Cauchy-Schwarz).
"""
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.windows import md5_order
from ..session import stored
from .blocks import from_bytes, paired, squares, to_bytes, vectors

SLICES = 12                    # tasks that meet all pairs; each gets all points once
SHARES = 6                     # blocks of the first pass: 21 tasks
CELLS, BINS = 512, 16_000_000  # cells between two knots; bins of a slice on either side
PART = 2 ** 18                 # bins summed up at a time
HELD_BYTES = 2 ** 26           # two blocks of doubles are held at a time
ROWS, COLUMNS, STEP = 128, 1024, 2048
SAMPLE, GRID = 1000, 16_384
CODES, COUNT = 2 ** 18 - 1, 2 ** 40  # a bin's number in the upper bits, the sum of rough ranks (in 18 bits each) below
LEAST, MOST = 1e-60, 1e60      # of the largest number: its squares stay finite
EPS = float(np.finfo(float).eps)


class Scale:
    """Cells in order of the value: a value's cell and its place inside, the same for equal values."""

    def __init__(self, sample):
        sample = np.sort(sample)
        picks = np.unique(np.quantile(sample, np.arange(61) / 60, method="nearest"))
        while len(more := self._uneven(sample, picks)):
            picks = np.union1d(picks, more)
        often = np.searchsorted(sample, picks, "right") - np.searchsorted(sample, picks)
        self.ties, self.heavy = bool((often > 1).any()), bool(often[often > 1].sum() > 1e-4 * len(sample))
        self.knots = np.unique(np.r_[0.0, picks, np.nextafter(picks[often > 1], np.inf), 4 * picks[-1]])  # a value of several gets cells of its own
        self.units = np.r_[CELLS / np.maximum(np.diff(self.knots), 1e-300), 0.0]
        self.upper = np.r_[self.knots[1:], np.nan]
        self.cells = CELLS * len(self.knots)
        self.low = self.knots[1]
        self.fine = GRID / max(picks[-1] - self.low, 1e-300)
        held = np.bincount(self._even(self.knots), minlength=GRID)
        self.first = (np.cumsum(held) - held - 1).astype(np.int32)  # the last knot below a cell of an even grid
        self.steps = int(held.max())
        self.first[0] = max(self.first[0], 0)

    @staticmethod
    def _uneven(sample, picks):
        """Medians between two picks, where they are near one of them."""
        low, high = np.searchsorted(sample, picks[:-1], "right"), np.searchsorted(sample, picks[1:])
        middle = sample[np.minimum((low + high) // 2, len(sample) - 1)]
        part = (middle - picks[:-1]) / np.diff(picks)
        return middle[(high - low > 1) & (np.abs(part - 0.5) > 0.45) & (middle > picks[:-1]) & (middle < picks[1:])]

    def _even(self, v):
        at = v - self.low
        at *= self.fine
        np.maximum(at, 0, out=at)
        np.minimum(at, GRID - 1, out=at)
        return at.astype(np.int32)

    def places(self, v):
        """(cell, place inside from 0 to 1)."""
        if self.steps > 8:
            at = (np.searchsorted(self.knots, v, "right") - 1).astype(np.int32)
        else:
            at = self.first.take(self._even(v))
            for _ in range(self.steps):
                more = v >= self.upper.take(at)
                if not more.any():
                    break
                at += more
        place = (v - self.knots.take(at)) * self.units.take(at)
        cell = np.minimum(place, CELLS - 1).astype(np.int32)
        place -= cell
        cell += at * CELLS
        return cell, place

    def edge(self, cell):
        """The least value of a cell, as far as rounding goes."""
        if cell <= 0 or cell >= self.cells:
            return -math.inf if cell <= 0 else math.inf
        at, of = divmod(int(cell), CELLS)
        return self.knots[at] + of / self.units[at] if self.units[at] else (math.inf if of else self.knots[at])


def _sides(z, width):
    return z[:, :width], z[:, width:]


def _factors(za, zb):
    """(left, right, largest norm) with ``left @ right`` the squared distances, rounded."""
    left, right, _ = squares(za, zb)
    return left, np.ascontiguousarray(right.T), left[:, -2].max() + right[:, -1].max()


def _tiles(rows, columns, same):
    return [(r, c) for r in range(0, rows, ROWS) for c in range(r if same else 0, columns, COLUMNS)]


def _packed(rows, count):
    def pack(table):
        return pa.table({"block": table["block"][:1], "n": pa.array([len(table)], pa.int32()), "z": [to_bytes(vectors(table["z"]))]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    return stored(dealt.groupBy("block").applyInArrow(pack, "block int, n int, z binary"))


def _cell_counts(rows, width, scales, count):
    """About how many distances of either side are in each cell."""
    exact = any(s.heavy for s in scales)

    def work(table):
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        blocks = {b: from_bytes(z, n) for b, n, z in zip(table["block"].to_pylist(), table["n"].to_pylist(), table["z"])}
        totals = [np.zeros(s.cells, np.int64) for s in scales]
        if len(blocks) == 1 + (i != j):  # else the hash left the other block empty
            za, zb = blocks[i], blocks[j]
            shift = za.mean(0)
            for scale, total, a, b in zip(scales, totals, _sides(za - shift * (not exact), width), _sides(zb - shift * (not exact), width)):
                if exact:  # rounding would take equal distances apart
                    for r, row in enumerate(a):
                        diff = b[r + 1 if i == j else 0:] - row
                        total += np.bincount(scale.places(np.sqrt(np.einsum("ij,ij->i", diff, diff)))[0], minlength=scale.cells)
                    continue
                left, right, _ = _factors(a, b)
                for r, c in _tiles(len(a), len(b), i == j):
                    d = left[r:r + ROWS] @ right[:, c:c + COLUMNS]
                    known = d[np.arange(c, c + d.shape[1]) > np.arange(r, r + len(d))[:, None]] if i == j and c < r + ROWS else d.ravel()
                    total += np.bincount(scale.places(np.sqrt(np.maximum(known, 0)))[0], minlength=scale.cells)
        found = [(side, cell, n) for side, total in enumerate(totals) for cell, n in [(np.flatnonzero(total), total[total > 0])]]
        return pa.table({"side": np.concatenate([np.full(len(c), s, np.int32) for s, c, _ in found]),
                         "cell": np.concatenate([c.astype(np.int32) for _, c, _ in found]), "n": np.concatenate([n for *_, n in found])})

    met = paired(_packed(rows, count), count * (count + 1) // 2, F.sequence(F.lit(0), F.lit(count - 1)))
    counts = met.groupBy("i", "j").applyInArrow(work, "side int, cell int, n long").groupBy("side", "cell").agg(F.sum("n").alias("n")).toArrow()
    out = [np.zeros(s.cells, np.int64) for s in scales]
    for side in (0, 1):
        of = counts.filter(pc.equal(counts["side"], side))
        out[side][of["cell"].to_numpy()] = of["n"].to_numpy()
    return out


class Slice:
    """The distances of one side whose cells are in [low, high), counted in bins."""

    def __init__(self, scale, counts, codes, other, low, high, bins, pairs):
        self.scale, self.low, self.high, self.other, self.codes, self.pairs = scale, low, high, other, codes[low:high], pairs
        self.start = float(counts[:low].sum()) - (pairs + 1) / 2
        share = counts[low:high] / max(1, counts[low:high].sum())
        self.parts = np.maximum(1, np.ceil(share * bins)).astype(np.int32)
        self.first = np.cumsum(self.parts, dtype=np.int64) - self.parts
        size = int(self.parts.sum())
        units = np.minimum(np.repeat(scale.units, CELLS), 1e250)
        self.per_bin, self.per_cell = float((units[low:high] * self.parts).max(initial=0)), float(units.max())
        self.place_error = 1e-9 + 1e-12 * float(self.parts.max(initial=0))
        self.wide = counts.max() >= 2 ** 22  # a bin might outgrow its bits
        self.n, self.sums = np.zeros(size, np.int64), np.zeros(size if self.wide else 0, np.int64)
        self.value, self.mixed = (np.full(size, np.nan), np.zeros(size, bool)) if scale.ties else (None, None)

    def reach(self, error):
        """Bounds of the squared distances that may belong here, given the error of squared distances."""
        low, high = self.scale.edge(self.low), self.scale.edge(self.high)
        return -math.inf if low <= 0 else low * low * (1 - 1e-9) - error, high * high * (1 + 1e-9) + error

    def bins_of(self, cell, place):
        """(bin, place inside) of cells of this slice."""
        cell = cell - self.low
        parts = self.parts.take(cell, mode="clip")
        place = place * parts
        return self.first.take(cell, mode="clip") + np.minimum(place.astype(np.int32), parts - 1), place

    def add(self, cell, place, value, others):
        """Distances of this side, and the cells of the other side's."""
        inside = (cell >= self.low) & (cell < self.high)
        if not inside.all():
            cell, place, others = cell[inside], place[inside], others[inside]
            value = None if value is None else value[inside]
        at, _ = self.bins_of(cell, place)
        if self.wide:
            np.add.at(self.n, at, 1)
            np.add.at(self.sums, at, self.other.take(others))
        else:
            np.add.at(self.n, at, self.other.take(others) + COUNT)
        if self.value is not None:
            seen = self.value.take(at)
            new = np.isnan(seen)
            self.value[at[new]] = value[new]
            self.mixed[at[self.value.take(at) != value]] = True

    def totals(self):
        """Sums over the slice; ranks are counted from the mean rank, as if the rough counts below the slice were right."""
        step, lift = self.pairs / CODES, -(self.pairs + 1) / 2
        out, below = np.zeros(9), self.start
        cells = np.searchsorted(self.first, np.arange(0, len(self.n) + PART, PART))  # cells are taken whole
        for low, high in zip(np.unique(cells), np.unique(cells)[1:]):
            at = slice(self.first[low], self.first[high - 1] + self.parts[high - 1])
            held = np.flatnonzero(self.n[at])
            n, codes = (self.n[at][held], self.sums[at][held]) if self.wide else np.divmod(self.n[at][held], COUNT)
            n = n.astype(float)
            s, rough = step * codes + lift * n, step * np.repeat(self.codes[low:high], self.parts[low:high])[held] + lift
            mean = below + (np.cumsum(n) - n) + (n + 1) / 2
            below += n.sum()
            off = mean - rough
            several = n * (n * n - 1) / 12 * (1.0 if self.mixed is None else self.mixed[at][held])
            out += [n.sum(), s.sum(), mean @ s, rough @ s, n @ mean, n @ (mean * mean), n @ off, n @ (off * off), several.sum()]
        return out.tolist()


TOTALS = ("n", "s", "ms", "rs", "m", "mm", "d", "dd", "open")


def _slices(blocks, width, scales, counts, codes, edges, turn, bins, pairs):
    """One row of sums for each side of each slice of this turn."""
    names = ("slice", "side", *TOTALS)
    exact = any(s.ties for s in scales)

    def measured(za, zb, i, j):
        """Distances of pairs from their differences: equal pairs are equally far."""
        out = np.empty((2, len(i)))
        for at in range(0, len(i), STEP):
            diff = zb.take(j[at:at + STEP], 0)
            diff -= za.take(i[at:at + STEP], 0)
            for side, part in enumerate(_sides(diff, width)):
                np.einsum("ij,ij->i", part, part, out=out[side, at:at + STEP])
        return np.sqrt(out)

    def meet(sides, za, zb, same):
        """Products of blocks give the distances; those that rounding could move to another bin or cell are taken from differences."""
        shift = za.mean(0)
        parts = list(zip(_sides(za - shift, width), _sides(zb - shift, width)))
        factors, moved = [_factors(a, b) for a, b in parts], 4 * EPS * math.sqrt(za.shape[1]) * max(np.abs(za).max(), np.abs(zb).max())
        errors = [4 * (za.shape[1] + 8) * EPS * norm for *_, norm in factors]  # of squared distances
        slacks = [moved + (za.shape[1] + 8) * EPS * math.sqrt(2 * norm) for *_, norm in factors]  # of distances
        reach = [s.reach(e + 4 * slack * math.sqrt(2 * norm)) for s, e, slack, (*_, norm) in zip(sides, errors, slacks, factors)]

        room = np.empty((2, ROWS * COLUMNS))

        def near(place, v, per, side, more):
            return (np.abs(place - np.rint(place)) - (per * slacks[side] + more)) * v <= per * errors[side]

        for r, c in _tiles(len(za), len(zb), same):
            height, columns = min(ROWS, len(za) - r), min(COLUMNS, len(zb) - c)
            d = [np.matmul(left[r:r + ROWS], right[:, c:c + COLUMNS], out=space[:height * columns].reshape(height, columns))
                 for space, (left, right, _) in zip(room, factors)]
            for side, (low, high) in enumerate(reach):
                mask = d[side] >= low
                mask &= d[side] <= high
                if same and c < r + ROWS:
                    mask &= np.arange(c, c + columns) > np.arange(r, r + height)[:, None]
                hit = np.flatnonzero(mask)
                if not len(hit):
                    continue
                own, other = sides[side], scales[1 - side]
                if exact:
                    v = measured(za, zb, r + hit // columns, c + hit % columns)
                    own.add(*own.scale.places(v[side]), v[side], other.places(v[1 - side])[0])
                    continue
                v, w = [np.sqrt(np.maximum(d[m].take(hit), 0)) for m in (side, 1 - side)]
                (cell, place), (others, within) = own.scale.places(v), other.places(w)
                open_ = near(own.bins_of(cell, place)[1], v, own.per_bin, side, own.place_error)
                open_ |= near(within, w, sides[1 - side].per_cell, 1 - side, 1e-9)
                k = np.flatnonzero(open_)
                if len(k):
                    v = measured(za, zb, r + hit[k] // columns, c + hit[k] % columns)
                    cell[k], place[k] = own.scale.places(v[side])
                    others[k] = other.places(v[1 - side])[0]
                own.add(cell, place, None, others)

    def work(batches):
        mine = sides = left = None

        def done():
            rows = [[mine, side, *s.totals()] for side, s in enumerate(sides)] if sides else []
            return pa.RecordBatch.from_arrays([pa.array([r[m] for r in rows], pa.int32() if m < 2 else pa.float64()) for m in range(len(names))], names)

        for batch in batches:
            for row, kept in zip(batch.select(["slice", "i", "block", "n"]).to_pylist(), batch.column("z")):
                z = from_bytes(kept, row["n"])
                if row["slice"] != mine:
                    if sides:
                        yield done()
                    mine, left = row["slice"], None
                    at = turn * SLICES + mine
                    sides = [Slice(scales[m], counts[m], codes[m], codes[1 - m], int(edges[m][at]), int(edges[m][at + 1]), bins, pairs) for m in (0, 1)]
                if row["i"] == row["block"]:
                    left = (row["i"], z)
                if left and left[0] == row["i"]:  # else the hash left that block empty
                    meet(sides, left[1], z, row["i"] == row["block"])
        if sides:
            yield done()

    met = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), "block"))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    met = met.select("slice", "i", "block", "n", "z").repartitionById(SLICES, "slice").sortWithinPartitions("slice", "i", "block")
    return [r.asDict() for r in met.mapInArrow(work, "slice int, side int, " + ", ".join(f"{c} double" for c in TOTALS)).collect()]


def _bounds(sums, counts, edges, pairs):
    """(value, distance to either bound) from the sums of all slices; None where no bound can be given."""
    total = np.zeros((2, len(TOTALS)))
    for side in (0, 1):
        below = 0.0
        for r in sorted((r for r in sums if r["side"] == side), key=lambda r: r["at"]):
            by = below - float(counts[side][:edges[side][r["at"]]].sum())  # what the rough counts below were off
            below += r["n"]
            moved = dict(r, ms=r["ms"] + by * r["s"], m=r["m"] + by * r["n"], mm=r["mm"] + 2 * by * r["m"] + by * by * r["n"],
                         d=r["d"] + by * r["n"], dd=r["dd"] + 2 * by * r["d"] + by * by * r["n"])
            total[side] += [moved[c] for c in TOTALS]
    x, y = [dict(zip(TOTALS, t.tolist())) for t in total]
    if x["n"] != pairs or y["n"] != pairs or not np.isfinite(total).all():
        return None
    if any(s["mm"] == 0 and s["open"] == 0 for s in (x, y)):
        return math.nan, 0.0  # one value
    if x["mm"] <= 0 or y["mm"] <= 0:
        return None
    product = x["ms"] + y["ms"] - x["rs"]
    root = lambda v: math.sqrt(max(v, 0.0))
    error = root(x["dd"]) * root(y["dd"]) + root(x["open"]) * root(y["mm"] + y["open"]) + root(y["open"]) * root(x["mm"])
    least, most = root(x["mm"]) * root(y["mm"]), root(x["mm"] + x["open"]) * root(y["mm"] + y["open"])
    low, high = product - error, product + error
    low, high = min(low / least, low / most), max(high / least, high / most)
    return (low + high) / 2, (high - low) / 2 + 1e-11  # sums of doubles


def bounded_rank_agreement(rows: DataFrame, n: int, width: int, digits: int, tile: int, turns=(1, 3, 9)):
    """Rank correlation of the distances in the first ``width`` places of ``z`` and in the others; rows (id, z).

    Right to ``digits`` decimal places; NaN where a side is constant; None where the bounds do not round alike. More turns take
    narrower slices, one after another.
    """
    pairs = n * (n - 1) // 2
    largest = rows.agg(F.max(F.array_max(F.transform("z", F.abs)))).first()[0]  # NaN is the largest
    if not LEAST < (largest or 0) < MOST:
        return None
    seen = np.array([r["z"] for r in rows.orderBy(md5_order(F.lit(5), "id"), "id").limit(SAMPLE).select("z").collect()], float)
    sample = [np.concatenate([np.sqrt(((part[i + 1:] - part[i]) ** 2).sum(1)) for i in range(len(part))]) for part in _sides(seen, width)]
    scales = [Scale(s) for s in sample]
    size = n * 8 * seen.shape[1]
    counts = _cell_counts(rows, width, scales, max(1, min(SHARES, -(-n // tile)), -(-size // HELD_BYTES)))
    codes = [np.rint((np.cumsum(c) - (c - 1) / 2) * (CODES / pairs)).clip(0, CODES).astype(np.int64) for c in counts]
    blocks = _packed(rows, max(1, -(-size // HELD_BYTES)))
    for many in turns:
        goals = pairs * np.arange(1, SLICES * many) / (SLICES * many)
        edges = [np.r_[0, np.minimum(np.searchsorted(np.cumsum(c), goals) + 1, s.cells), s.cells] for c, s in zip(counts, scales)]
        bins = min(BINS, 64 * pairs // (SLICES * many) + 1)
        sums = []
        for turn in range(many):
            sums += [dict(r, at=turn * SLICES + r["slice"]) for r in _slices(blocks, width, scales, counts, codes, edges, turn, bins, pairs)]
        found = _bounds(sums, counts, edges, pairs)
        if found is None:
            return None
        value, by = found
        rounded = lambda v: (math.floor(v * 10 ** digits + 0.5), math.ceil(v * 10 ** digits - 0.5))
        if math.isnan(value) or rounded(value - by) == rounded(value + by):
            return value
    return None
