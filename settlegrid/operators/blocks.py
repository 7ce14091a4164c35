"""Blocks of points as packed numbers, and every unordered pair of blocks once.

All-pairs work ships each block once per partner, so what is shuffled is the points times the number of blocks. That number
stays at ``BLOCKS`` while a block fits ``BLOCK_BYTES``: until then shuffles grow as the points do and only arithmetic grows
with their square. Beyond, memory stays bounded and blocks get more.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCKS = 12             # 78 pairs: enough tasks for a few dozen cores
BLOCK_BYTES = 2 ** 25   # 65,536 points of 64 doubles
ROWS, COLUMNS = 256, 2048


def block_count(points: DataFrame, tile: int) -> tuple:
    """(points, blocks): blocks of about ``tile`` points, at most ``BLOCKS`` of them unless they would outgrow memory."""
    n, width = points.agg(F.count("*"), F.coalesce(F.max(F.size("z")), F.lit(1))).first()
    return n, max(1, min(BLOCKS, -(-n // tile)), -(-n * 8 * width // BLOCK_BYTES))


def vectors(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def to_bytes(z: np.ndarray) -> bytes:
    """A matrix as bytes, in single precision where that loses nothing; the first byte tells."""
    with np.errstate(over="ignore"):
        single = z.astype("f4")
    return b"f" + single.tobytes() if np.array_equal(single, z, equal_nan=True) else b"d" + z.tobytes()


def from_bytes(cell, rows: int) -> np.ndarray:
    """The matrix of ``to_bytes`` in double precision."""
    kept = cell.as_py()
    return np.frombuffer(kept, "f4" if kept[:1] == b"f" else "f8", offset=1).astype(float).reshape(rows, -1)


def numbers(cell, kind=float) -> np.ndarray:
    """A packed cell as a flat array that may be written to."""
    return np.frombuffer(cell.as_py(), kind).copy()


def paired(blocks: DataFrame, pairs: int, partners) -> DataFrame:
    """Rows (i, j, and the block's own columns), one per block of each pair i <= j; dealt by pair.

    ``partners`` is the array of a block's partners, itself included where the pair with itself is wanted.
    """
    rows = blocks.withColumn("_with", F.explode(partners)).withColumns(
        {"i": F.least("block", "_with"), "j": F.greatest("block", "_with")}).drop("_with")
    return rows.repartition(max(1, pairs), "i", "j")


def squares(za: np.ndarray, zb: np.ndarray) -> tuple:
    """(left, right, error): ``left[r] @ right[c].T`` are squared distances, off by at most ``error`` times the squared norms."""
    na, nb = (za * za).sum(1), (zb * zb).sum(1)
    left = np.concatenate([-2 * za, na[:, None], np.ones((len(za), 1))], 1)
    right = np.concatenate([zb, np.ones((len(zb), 1)), nb[:, None]], 1)
    return left, right, 4 * (za.shape[1] + 8) * np.finfo(float).eps


def exact(za: np.ndarray, zb: np.ndarray, i: np.ndarray, j: np.ndarray, step=65_536) -> np.ndarray:
    """Distances of the pairs (i, j) from their differences: equal points are 0 apart, equal pairs equally far."""
    out = np.empty(len(i))
    for at in range(0, len(i), step):
        diff = zb[j[at:at + step]] - za[i[at:at + step]]
        out[at:at + step] = np.sqrt((diff * diff).sum(1))
    return out
