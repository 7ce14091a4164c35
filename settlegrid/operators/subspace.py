"""Leading right singular vectors of a long matrix (id, pos, value), by a randomised block range finder.

The matrix is only ever multiplied: a pass joins it to a thin table of one array a row, and adds products by the other
axis. Thin tables are made orthonormal by a QR whose triangles are formed per task and merged in two levels. The driver
sees those triangles (as wide as the basis, some hundred columns at most); rows, positions and their covariance stay
tables, so neither axis is bounded by its memory.
"""
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable

MERGERS = 16


def gaussian(key, column: int, seed: int) -> Column:
    """A standard normal number that depends on (key, column, seed) alone, whatever task makes it."""
    part = lambda salt: (F.pmod(F.xxhash64(key, F.lit(column), F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.ln(part(0))) * F.cos(2 * math.pi * part(1))


def triangle(thin: DataFrame, col: str) -> np.ndarray:
    """R of the QR of a table of arrays. Tasks keep one triangle, and a few mergers stack theirs before the driver does."""
    def reduce(frames):
        r = None
        for frame in frames:
            rows = [np.asarray(v, float) for v in frame["row"]]
            if rows:
                stack = np.array(rows) if r is None else np.vstack([r, *rows])
                r = np.linalg.qr(stack, mode="r")
        if r is not None:
            yield pd.DataFrame({"row": list(r)})

    first = thin.select(F.col(col).alias("row")).mapInPandas(reduce, "row array<double>")
    merged = first.repartition(MERGERS).mapInPandas(reduce, "row array<double>")
    rows = [r["row"] for r in merged.collect()]
    return np.linalg.qr(np.array(rows, float), mode="r") if rows else np.zeros((0, 0))


def _times(thin: DataFrame, key: str, source: str, m: np.ndarray, out: str, kept=()) -> DataFrame:
    """Rows of ``thin`` with the array ``source`` times a small matrix as ``out``."""
    def work(frames):
        for frame in frames:
            product = np.array(frame[source].tolist(), float).reshape(len(frame), len(m)) @ m
            yield frame[[key, *kept]].assign(**{out: list(product)})
    kinds = {f.name: f.dataType.simpleString() for f in thin.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, *kept)) + f", {out} array<double>"
    return thin.select(key, source, *kept).mapInPandas(work, schema)


def _product(matrix: DataFrame, thin: DataFrame, on: str, to: str, col: str, width: int) -> DataFrame:
    """Sums over ``on`` of value times the thin array: one array per ``to``. AQE broadcasts the thin side if it is small."""
    sums = [F.sum(F.col("value") * F.get(col, F.lit(j))).alias(f"_{j}") for j in range(width)]
    return matrix.join(thin, on).groupBy(to).agg(*sums).select(to, F.array(*[f"_{j}" for j in range(width)]).alias("fresh"))


def _orthonormal(thin: DataFrame, width: int, tolerance: float):
    """``both`` arrays hold an orthonormal part of ``width`` columns and fresh ones: (fresh made orthonormal to it and to
    each other, their number). Directions the first part already spans, up to ``tolerance``, are dropped."""
    for _ in range(2):
        r = triangle(thin, "both")
        if len(r) < r.shape[1]:
            r = np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])
        inside = np.linalg.solve(r[:width, :width], r[:width, width:]) if width else np.zeros((0, r.shape[1]))
        _, size, turn = np.linalg.svd(r[width:, width:])
        kept = size > tolerance * max(np.abs(r[:, width:]).max(initial=0), np.finfo(float).tiny)
        fresh = turn[kept].T / size[kept]
        count = int(kept.sum())
        if not count:
            return None, 0
        move = np.vstack([-inside @ fresh, fresh])
        keep = np.vstack([np.eye(width), np.zeros((r.shape[1] - width, width))])
        thin = durable(_times(thin, "pos", "both", np.hstack([keep, move]), "both"))
    return thin, count


def leading_directions(matrix: DataFrame, k: int, oversample: int = 10, seed: int = 7, tolerance: float = 1e-9, rounds: int = 12):
    """(components (pos, c array<double>), singular values) of the first ``k`` directions of the matrix's rows.

    A Gaussian sketch of ``k + oversample`` columns starts the basis; each round multiplies the newest block by the matrix
    and its transpose and adds what is new, so the basis is a block Krylov space. It ends when the first ``k`` singular
    values no longer move by ``tolerance``, when nothing new comes (then the result is exact), or after ``rounds``. Fewer
    than ``k`` directions come back from a matrix of lower rank; the largest loading of each is positive.
    """
    width = k + oversample
    matrix = matrix.select("id", "pos", "value")
    start = matrix.select("pos").distinct().select("pos", F.array(*[gaussian("pos", j, seed) for j in range(width)]).alias("both"))
    basis, count = _orthonormal(durable(start), 0, 1e-7)
    if not count:
        return start.select("pos", F.array().cast("array<double>").alias("c")), np.zeros(0)
    images, total, before = None, 0, None
    for turn in range(rounds):
        newest = basis.select("pos", F.slice("both", total + 1, count).alias("q"))
        image = _product(matrix, newest, "pos", "id", "q", count)
        images = durable(image if images is None else images.join(image.withColumnRenamed("fresh", "_new"), "id").select(
            "id", F.concat("fresh", "_new").alias("fresh")))
        total += count
        r = triangle(images, "fresh")
        _, size, turned = np.linalg.svd(r)
        size = np.r_[size, np.zeros(max(0, total - len(size)))]
        leading = size[:k]
        if before is not None and np.abs(leading - before).max() <= tolerance * max(leading[0], np.finfo(float).tiny):
            break
        before = leading
        if turn + 1 == rounds:
            break
        back = _product(matrix, images.select("id", F.slice("fresh", total - count + 1, count).alias("y")), "id", "pos", "y", count)
        joined = basis.join(back, "pos").select("pos", F.concat("both", "fresh").alias("both"))
        grown, count = _orthonormal(durable(joined), total, 1e-7)
        if not count:
            break
        basis = grown
    rank = int((size[:k] > 1e-12 * max(size[0], np.finfo(float).tiny)).sum())
    components = durable(_times(basis.select("pos", F.slice("both", 1, total).alias("both")), "pos", "both", turned[:rank].T, "c"))
    best = components.agg(*[F.max_by(F.get("c", F.lit(j)), F.abs(F.get("c", F.lit(j)))).alias(f"_{j}") for j in range(rank)]).first() if rank else []
    signs = [-1.0 if s < 0 else 1.0 for s in best]
    turned_signs = F.array(*[F.get("c", F.lit(j)) * F.lit(s) for j, s in enumerate(signs)]) if rank else F.col("c")
    return components.select("pos", turned_signs.alias("c")), size[:rank]
