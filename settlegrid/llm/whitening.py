"""Whitening of embeddings on leading components found by spectrum slicing of their covariance."""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..checks import ContractError, guard
from .common import stored

EPS = np.finfo(float).eps


# --- spectrum slicing of one symmetric d x d matrix (numpy, on the driver; d is the width of a vector) ---

def inertia(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix, read off the blocks of D in P A P' = L D L'.

    Pivots are the largest diagonal entry or, where an off-diagonal one outweighs it, a 2 x 2 block, which then holds
    one positive and one negative eigenvalue.
    """
    a, above, share = np.array(a, float), 0, (1 + 17 ** 0.5) / 8
    while len(a):
        diagonal = np.abs(a.diagonal())
        p = int(diagonal.argmax())
        off = np.abs(np.triu(a, 1))
        r, q = divmod(int(off.argmax()), len(a))
        if max(diagonal[p], off[r, q]) == 0:
            break
        if diagonal[p] >= share * off[r, q]:
            above += a[p, p] > 0
            pivot, block = [p], a[p:p + 1, p:p + 1]
        else:
            above += 1
            pivot, block = [r, q], a[np.ix_([r, q], [r, q])]
        rest = np.delete(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return int(above)


def _solve(v, shift, right):
    """(V - shift) x = right; an exactly singular matrix is shifted by a rounding error more."""
    step = EPS * max(np.abs(v).max(), np.finfo(float).tiny)
    for k in (0, 1, 8, 64):
        try:
            out = np.linalg.solve(v - (shift + k * step) * np.eye(len(v)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(out).all():
            return out
    raise ArithmeticError("shifted covariance could not be solved")


def leading_components(v: np.ndarray, k: int, least: float = 1e-12):
    """(eigenvalues, unit eigenvectors as columns) of the first ``k`` components of a covariance, largest first.

    The spectrum is sliced by inertia counts of V - s I: bisection narrows an interval until the count at its lower end
    is one more than at its upper end, so it holds one eigenvalue of known number. Rayleigh quotient iteration starts
    from an inverse iteration at its middle; a value that leaves the interval sends the bisection on. Counts on both
    sides of the value certify its number. Iterations see the matrix without the components already found, so close
    eigenvalues keep orthogonal vectors; those closer to each other than rounding are taken together, with an
    orthonormal basis of their space. Components below ``least`` of the trace have no direction and are left out.
    """
    v = (np.asarray(v, float) + np.asarray(v, float).T) / 2
    d, trace = len(v), float(np.trace(v))
    if not d or trace <= 0:
        return np.zeros(0), np.zeros((d, 0))
    radius = np.abs(v).sum(1) - np.abs(v.diagonal())
    top, tight = float((v.diagonal() + radius).max()), 16 * d * EPS * float(np.abs(v).max())
    top += tight
    floor = max(least * trace, tight)
    counts = {}

    def above(s):
        if s not in counts:
            counts[s] = inertia(v - s * np.eye(d))
        return counts[s]

    k = min(k, above(floor))
    values, vectors = [], np.zeros((d, 0))
    start = np.random.default_rng(1).standard_normal((d, d))
    while len(values) < k:
        number = len(values)  # eigenvalues above the interval
        low = max([s for s, c in counts.items() if c > number], default=floor)
        high = min([s for s, c in counts.items() if c <= number] + [top])
        value = None
        while value is None:
            if above(low) - number > 1 and high - low > tight:
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) > number else (low, middle)
                continue
            many, shift = above(low) - number, (low + high) / 2
            left, basis = v - (vectors * values) @ vectors.T, start[:, :many]
            for _ in range(4 if many > 1 else 2):
                basis = basis - vectors @ (vectors.T @ basis)
                basis = np.linalg.qr(_solve(left, shift, basis))[0]
            if many == 1:
                x = basis[:, 0]
                for _ in range(12):
                    rho = float(x @ v @ x)
                    if np.linalg.norm(v @ x - rho * x) <= 4 * EPS * np.abs(v).max():
                        break
                    x = _solve(left, rho, x)
                    x -= vectors @ (vectors.T @ x)
                    x /= np.linalg.norm(x)
                rho = float(x @ v @ x)
                inside = low - tight <= rho <= high + tight
                if (not inside or above(rho - tight) <= number or above(rho + tight) > number) and high - low > tight:
                    middle = (low + high) / 2
                    low, high = (middle, high) if above(middle) > number else (low, middle)
                    continue
                value, basis = [rho], x[:, None]
            else:
                value, turn = np.linalg.eigh(basis.T @ v @ basis)
                value, basis = value[::-1].tolist(), (basis @ turn)[:, ::-1]
        values += value
        vectors = np.c_[vectors, basis]
    return np.array(values[:k]), vectors[:, :k]


# --- the table side ---

def lattice(vector: Column, scale: int, shift: int) -> Column:
    """Each entry c as floor(scale * c) + shift, a long; null where the vector or an entry is null or not finite.

    Entries beyond 2^53 / scale have no exact long and stop the job.
    """
    real = lambda c: c.cast("double")
    known = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(real(c)) < float("inf")))
    entry = lambda c: guard(F.floor(real(c) * scale) + shift, F.abs(real(c) * scale) >= 2.0 ** 53, "entry has no exact long", "bigint")
    return F.when(known, F.transform(vector, entry))


def _matrix(batch, d):
    """Vectors (last column) of an Arrow batch as an n x d array of longs."""
    return batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(batch.num_rows, d)


def _sums(d):
    def run(batches):
        total, n = np.zeros(d, np.int64), 0
        for batch in batches:
            x = _matrix(batch, d)
            total, n = total + x.sum(0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], ["i", "value"])
    return run


def _products(d, centred, width):
    """Sums of products of the columns that ``centred`` makes of a batch's vectors: one row of sums per column and task."""
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            y = centred(_matrix(batch, d))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])
    return run


def _covariance(fit: DataFrame, n: int, d: int, centred, width: int) -> np.ndarray:
    """Covariance (divisor n); tasks send width x width sums, which are added by key before they reach the driver."""
    parts = fit.select("x").mapInArrow(_products(d, centred, width), "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((width, width))
    for r in cells.collect():
        out[r.i, r.j] = r.value
    return out / n


@dataclass
class Whitening:
    """Fitted whitening: count, exact sums, components and the measured error of the whitened fit list."""
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def deviations(self, x):
        """n * x - sums, exactly."""
        if self.n and len(x) and float(self.n) * np.abs(x).max(initial=0) + np.abs(self.sums).max(initial=0) >= 2.0 ** 62:
            raise OverflowError("n * x does not fit a long")
        return self.n * x - self.sums

    def centred(self, x):
        return self.deviations(x) / max(self.n, 1)

    def whiten(self, x):
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def apply(self, rows: DataFrame, key: str = "vec_id", col: str = "x") -> DataFrame:
        """One row per vector and component: key, component, n, deviation, whitened, explained, identity_error."""
        d, k = len(self.sums), len(self.values)

        def run(batches):
            for batch in batches:
                keys, x = batch.column(0), _matrix(batch, d)
                far, m = self.deviations(x), len(x)
                if m and d * float(np.abs(far).max(initial=0)) ** 2 >= 2.0 ** 63:
                    raise OverflowError("squared deviation does not fit a long")
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    keys.take(at), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, self.n), pa.int64()),
                    pa.array(np.repeat((far * far).sum(1), k), pa.int64()), pa.array(self.whiten(x).ravel()),
                    pa.array(np.tile(self.values / self.trace if k else self.values, m)), pa.array(np.full(m * k, self.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        out = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(col).alias("x")).mapInArrow(run, kinds)
        return out if key == "vec_id" else out.withColumnRenamed("vec_id", key)


def fit_whitening(vectors: DataFrame, k: int = 16, col: str = "x") -> Whitening:
    """Whitening on the first ``k`` components of the distinct vectors (arrays of longs, none null) of ``col``.

    Equal vectors meet in an aggregation that combines on the map side, so a vector of a third of all rows is one row a
    task. The distinct list is stored once; three passes over it give exact sums, centred products and the covariance
    of the whitened list, all as d x d sums per task added by key. The driver holds d x d numbers.
    """
    fit = stored(vectors.select(F.col(col).alias("x")).distinct())
    widths = fit.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if widths.low != widths.high:
        raise ContractError(f"vectors of {widths.low} to {widths.high} entries have no covariance")
    d = widths.low or 0
    found = fit.mapInArrow(_sums(d), "i int, value long").groupBy("i").agg(F.sum("value").alias("value")).collect()
    n, *sums = [r.value for r in sorted(found, key=lambda r: r.i)] or [0]
    model = Whitening(n, np.array(sums or [0] * d, np.int64), np.zeros(0), np.zeros((d, 0)), 0.0)
    if not n or not d:
        return model
    v = _covariance(fit, n, d, model.centred, d)
    model.values, model.vectors = leading_components(v, k)
    model.trace = float(np.trace(v))
    if len(model.values):
        white = _covariance(fit, n, d, model.whiten, len(model.values))
        model.identity_error = float(np.abs(white - np.eye(len(white))).max())
    return model


def whitened(embeddings: DataFrame, k: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id",
             vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component up to ``k``: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are dropped. Repeated rows each get their result and
    count once in the fit; null ids stay null. Components of (nearly) no variance, below 1e-12 of the trace, cannot be
    whitened and have no rows, so a table of equal vectors, of empty vectors or of no rows gives an empty result.
    Vectors of different lengths are refused. Other columns are not read.
    """
    rows = embeddings.select(F.col(id_col).alias("vec_id"), lattice(F.col(vector_col), scale, shift).alias("x")).where("x IS NOT NULL")
    return fit_whitening(rows, k).apply(rows)
