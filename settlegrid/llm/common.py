"""Helpers shared by the corpus operators: stored tables, folds, components."""
from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` under the shared folder and read it back.

    A lost executor then costs a re-read and not the chain behind it, and values such as row tags
    stay what they were when a task is run again.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 256):
    """The rows of Arrow batches a few at a time, so that only so many texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of every fit."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, *LOWER)


def partitions(spark, rows: int, per_task: int) -> int:
    """At least the session's shuffle partitions, and enough for ``per_task`` rows each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Alternating large-star and small-star steps: each round hangs every node under the smallest node it
    can see, until only stars are left. A node's smallest neighbour comes from an aggregation that combines
    on the map side and is joined back, so a hub with a third of all edges is summed in parts and split by
    the skew join; no neighbour list is built. Loops and edges with a null end are ignored. Each round is
    stored, and its row count and hash sum tell when nothing changes any more.
    """
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    found = stored(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        state = tuple(found.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        kept = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        found = stored(kept.select("e.*").where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = found.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
