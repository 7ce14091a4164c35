"""Quality by nearest neighbours: labelled latent-semantic vectors are broadcast and vote by cosine similarity."""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fold

SAMPLE = 4_000
GRAMS = 2048
SHAPES = 10
RANK = 40
NEIGHBOURS = 25
BLOCK = 256
SYMBOLS = "#$%&*|@^~<>"


def shape(text: str) -> list:
    """Dense traits of a whole text: repetition of words and lines, capitals, symbols, marks, digits, word length, size."""
    words = text.split()
    n, size = len(words) or 1, len(text) or 1
    repeated = sum(map(str.__eq__, words, words[1:])) / n
    lines = [x for x in text.split("\n") if x]
    upper = sum(w.isupper() and len(w) > 1 for w in words) / n
    return [repeated, 1 - len(set(words)) / n, 1 - len(set(lines)) / (len(lines) or 1), upper,
            sum(map(text.count, SYMBOLS)) / size, (text.count("!") + text.count("?")) / n, sum(map(text.count, "0123456789")) / size,
            min(size / n, 30) / 10, text.count("\n") / n, math.log1p(n)]


def grams(text: str, size: int = GRAMS) -> np.ndarray:
    """Hashed counts of the byte trigrams of the whole text, letter case kept."""
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(size, np.float32)
    mixed = (b[:-2] * np.uint32(65537) + b[1:-1] * np.uint32(257) + b[2:]) * np.uint32(2654435761)
    return np.bincount(mixed >> np.uint32(32 - int(math.log2(size))), minlength=size).astype(np.float32)


def raw_vectors(texts) -> tuple:
    texts = [t or "" for t in texts]
    counts = np.stack([grams(t) for t in texts]) if texts else np.zeros((0, GRAMS), np.float32)
    return counts, np.array([shape(t) for t in texts], np.float32).reshape(-1, SHAPES)


class LatentSpace:
    """TF-IDF of trigrams and standardised shape traits, both of length one, projected on the leading right singular vectors."""

    def __init__(self, counts, shapes, rank: int = RANK):
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        self.centre, self.spread = shapes.mean(0), shapes.std(0) + 1e-6
        joint = self._joint(counts, shapes)
        values, vectors = np.linalg.eigh(joint.T @ joint)
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :rank].astype(np.float32))

    def _joint(self, counts, shapes):
        def unit(x):
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
        return np.hstack([unit(np.log1p(counts) * self.idf), unit(np.clip((shapes - self.centre) / self.spread, -4, 4))]).astype(np.float32)

    def place(self, counts, shapes) -> np.ndarray:
        at = self._joint(counts, shapes) @ self.axes
        return at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-6)


def vote(points, known, marks, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Labels of the nearest ``neighbours`` by exact cosine against every known vector, weighted by similarity."""
    like = points @ known.T
    k = min(neighbours, len(known))
    near = np.argpartition(-like, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(like, near, 1), 0) ** 6 + 1e-9
    return (weight * marks[near]).sum(1) / weight.sum(1)


class NeighbourVote:
    def __init__(self, space, known, marks, base):
        self.space, self.known, self.marks, self.base = space, known, marks, base

    def __call__(self, texts) -> np.ndarray:
        if self.space is None:
            return np.full(len(texts), self.base)
        return vote(self.space.place(*raw_vectors(texts)), self.known, self.marks)


def _vectors(batches):
    for batch in batches:
        texts, marks = batch.column("text").to_pylist(), batch.column("quality")
        for start in range(0, len(texts), BLOCK):
            counts, shapes = raw_vectors(texts[start:start + BLOCK])
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.astype("<u4").tobytes() for c in counts], pa.binary()), pa.array([s.tobytes() for s in shapes], pa.binary()),
                 marks[start:start + BLOCK]], ["counts", "shapes", "quality"])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col="doc_id", text_col="text") -> NeighbourVote:
    """Fit on at most ``sample`` labelled rows outside fold 0, taken in hash order of their ids.

    The driver gets their vectors (8 kB each, 32 MB at most), never a text. Labels other than 0 and 1 and rows without
    an id are left out, and repeated rows of one id and text count once, before the limit; without any label the score is
    0.5 everywhere.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max("quality").cast("int").alias("quality"))
    known = known.where(fold(F.col("_id")) != 0).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(known), "_id")  # at most ``sample`` rows are broadcast
    one = found.groupBy("_id", F.xxhash64("text").alias("_hash")).agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    rows = one.orderBy(F.xxhash64("_id"), "_id", "_hash").limit(sample).select("text", "quality")
    got = rows.mapInArrow(_vectors, "counts binary, shapes binary, quality int").collect()
    if not got:
        return NeighbourVote(None, None, None, 0.5)
    counts = np.stack([np.frombuffer(r.counts, "<u4") for r in got]).astype(np.float32)
    shapes = np.stack([np.frombuffer(r.shapes, np.float32) for r in got])
    space = LatentSpace(counts, shapes)
    return NeighbourVote(space, space.place(counts, shapes), np.array([r.quality for r in got], np.float32), 0.5)


def _scorer(model):
    def run(batches):
        judge = model.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            score = np.concatenate([judge(texts[i:i + BLOCK]) for i in range(0, len(texts), BLOCK)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(score, 0, 1).astype(float))], ["doc_id", "score"])
    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The broadcast holds ``sample`` x 40 floats and the projection, about 1 MB whatever the corpus. Null text scores as
    empty, every text is read whole, repeated rows score alike; nothing but the text is read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, sample, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_scorer(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
