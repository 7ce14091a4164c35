"""Toxicity: boosted trees over dense text features, calibrated by isotonic regression."""
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from .common import fold, slices, stored

SAMPLE = 12_000
SEED_WORDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
SECOND_PERSON = frozenset("you your yours youre u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted tú ti".split())
WORD = re.compile(r"[^\W_]+")
HIDDEN = re.compile(r"[^\W\d_]+(?:[@$*!|.\-_0-9]+[^\W\d_]+)+")
PLAIN = str.maketrans("013457@$!|", "oieastasil", "*.-_")
STEM = 4
NEAR = 6
FEATURES = ("seed_density", "word_density", "stem_density", "hits", "densest", "near_you", "hidden_density", "capitals",
            "shouted", "marks", "symbols", "length")


def terms(text: Column) -> Column:
    """Distinct lower-cased words and, marked by a star, their first letters."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))
    return F.array_union(words, F.transform(F.filter(words, lambda w: F.length(w) > STEM),
                                            lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*"))))


def learn_lexicon(sample: DataFrame, least: int = 4, odds: float = 3.0):
    """Words and stems whose log odds of standing in a toxic text are at least ``odds``; texts count once, however often copied."""
    texts = sample.select("text", "toxic").distinct()
    n = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term"), "toxic").groupBy("term").agg(
        F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    gap = F.log((F.col("bad") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("good") + 0.5) / (n.get(0, 0) + 1))
    chosen = [r[0] for r in counts.where((F.col("bad") >= least) & (gap >= odds)).select("term").collect()]
    return (frozenset(t for t in chosen if not t.endswith("*")), frozenset(t[:-1] for t in chosen if t.endswith("*")))


def describe(text, words_known=frozenset(), stems=frozenset(), seeds=frozenset(SEED_WORDS)):
    """The dense features of one whole text, in the order of FEATURES."""
    text = text or ""
    words = WORD.findall(text.lower())
    n = len(words) or 1
    seed = sum(w in seeds for w in words)
    at = [i for i, w in enumerate(words) if w in words_known or w in seeds or (w[:STEM] in stems and len(w) > STEM)]
    known = sum(words[i] in words_known for i in at)
    stem = sum(words[i][:STEM] in stems for i in at)
    hidden = 0
    for m in HIDDEN.finditer(text.lower()):
        bare = m.group().translate(PLAIN)
        hidden += bare in seeds or bare in words_known or (bare[:STEM] in stems and len(bare) > STEM)
    densest = 0
    left = 0
    for right, i in enumerate(at):
        while i - at[left] > 50:
            left += 1
        densest = max(densest, right - left + 1)
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR):i + NEAR + 1]) for i in at)
    size = len(text) or 1
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks, symbols = text.count("!") + text.count("?"), sum(map(text.count, "#$%&*@|"))
    shouted = text.count("!!") + text.count("?!")
    return [seed / n, known / n, stem / n, math.log1p(len(at) + hidden), densest, near / n, hidden / n, upper / size, shouted / n,
            marks / n, symbols / size, math.log1p(n)]


def _describer(words, stems):
    def run(batches):
        for batch in slices(batches):
            rows = [describe(t, words, stems) for t in batch.column("_text").to_pylist()]
            flat = pa.array(np.array(rows, np.float64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, len(FEATURES)), pa.int32()), flat)
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [lists], names + ["_x"])
    return run


def featurise(rows: DataFrame, lexicon, text_col: str = "text") -> DataFrame:
    """``rows`` plus ``_x``, the features of the text, as a vector."""
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema)
    plain = rows.withColumn("_text", F.col(text_col)).mapInArrow(_describer(*lexicon), kinds + "_x array<double>")
    return plain.withColumn("_x", array_to_vector("_x"))


class ToxicityModel:
    """Lexicon, trees and calibration of one fit. Without labelled rows of both kinds every score is the share of toxic ones."""

    def __init__(self, lexicon, trees, curve, base):
        self.lexicon, self.trees, self.curve, self.base = lexicon, trees, curve, base

    def score(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        """``rows`` plus ``_score`` from 0 to 1."""
        if self.trees is None:
            return rows.withColumn("_score", F.lit(self.base))
        raw = self._raw(featurise(rows, self.lexicon, text_col))
        made = self.curve.transform(raw.withColumnRenamed("_p", "_feature")) if self.curve else raw.withColumn("_score", F.col("_p"))
        return made.select(*rows.columns, F.least(F.greatest("_score", F.lit(0.0)), F.lit(1.0)).alias("_score"))

    def _raw(self, described):
        made = self.trees.transform(described)
        return made.withColumn("_p", vector_to_array("_probability")[1]).drop("_raw", "_probability", "_predicted", "_x")


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col="doc_id", text_col="text") -> ToxicityModel:
    """Fit on at most ``sample`` labelled rows outside fold 0, taken in hash order of their ids.

    Folds 1 and 2 give the lexicon, fold 3 the trees, which so see lexicon counts of texts the lexicon was not made
    from, and fold 4 the calibration. Where fold 3 lacks a class, all four folds together give lexicon and trees, without
    a calibration; where all of them lack one, every score is the share of toxic rows. Labels other than 0 and 1 and rows
    without an id are left out; repeated rows of one id and text count once, before the limit.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("_fold", fold(F.col("_id"))).where("_fold <> 0")
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(known), "_id")  # at most ``sample`` rows are broadcast
    one = found.groupBy("_id", F.xxhash64("text").alias("_hash")).agg(F.first("_fold").alias("_fold"), F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = stored(one.orderBy(F.xxhash64("_id"), "_id", "_hash").limit(sample).select("_fold", "text", "toxic"))
    share = rows.agg(F.avg("toxic")).first()[0]
    kinds = {(r[0], r[1]) for r in rows.select("_fold", "toxic").distinct().collect()}
    if len({label for _, label in kinds}) < 2:
        return ToxicityModel(None, None, None, float(share or 0.0))
    if not {(3, 0), (3, 1)} <= kinds:
        rows, kinds, words = rows.withColumn("_fold", F.lit(3)), set(), rows
    else:
        words = rows.where(F.col("_fold").isin(1, 2))
    lexicon = learn_lexicon(words)
    described = stored(featurise(rows.where(F.col("_fold").isin(3, 4)), lexicon).drop("text").coalesce(2))
    trees = GBTClassifier(featuresCol="_x", labelCol="toxic", maxIter=15, maxDepth=3, stepSize=0.3, seed=7, predictionCol="_predicted")
    trees = trees.setProbabilityCol("_probability").setRawPredictionCol("_raw").fit(described.where("_fold = 3"))
    model = ToxicityModel(lexicon, trees, None, float(share))
    if {(4, 0), (4, 1)} <= kinds:
        raw = model._raw(described.where("_fold = 4")).select(F.col("_p").alias("_feature"), F.col("toxic").cast("double").alias("toxic"))
        model.curve = IsotonicRegression(featuresCol="_feature", labelCol="toxic", predictionCol="_score").fit(raw)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null text scores as empty, texts are read whole, repeated rows score alike, a null id is not held out. An empty table
    gives an empty result. Nothing but the text is read, so names of other columns do not matter.
    """
    model = fit_toxicity(docs, labels, sample, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = model.score(rows)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, text_col="text", id_col="doc_id") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns, whatever these are called."""
    model = fit_toxicity(docs, labels, sample, id_col, text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]  # none begins like the columns of the model
    scored = model.score(docs.toDF(*names), names[docs.columns.index(text_col)])
    return scored.where(F.col("_score") < threshold).select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns)])
