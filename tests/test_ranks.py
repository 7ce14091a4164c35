"""Ranks of values that a second run of the same plan computes a little differently."""
import numpy as np
from pyspark.sql import functions as F

from settlegrid.functions import ranks as K


def unsteady(spark, n):
    """(g, x, y): doubles whose last bits change with every evaluation, as those of sums added up in another order do."""
    def shake(frames):
        for frame in frames:
            noise = np.random.default_rng().integers(-4, 5, (2, len(frame)))
            yield frame[["g"]].assign(x=frame["i"] + noise[0] * 2.0 ** -30, y=-frame["i"] + noise[1] * 2.0 ** -30)
    return spark.range(1, n + 1, numPartitions=4).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("i")).mapInPandas(
        shake, "g int, x double, y double")


def test_no_pair_is_lost_when_values_differ_between_evaluations(spark):
    r = K.spearman(unsteady(spark, 500), ["g"], "x", "y").first()
    assert r["n_paired"] == 500 and abs(r["spearman"] + 1) < 1e-12
    ranked = K.average_ranks(unsteady(spark, 500), ["g"], "x", "r").select("r").toPandas()["r"]
    assert sorted(ranked) == list(range(1, 501))
    counts = K.value_counts(unsteady(spark, 500), ["g"], "x").select("below", "size").collect()
    assert sorted(c["below"] for c in counts) == list(range(500)) and {c["size"] for c in counts} == {500}
