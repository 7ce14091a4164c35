"""Exact ranks, quantiles and correlations, for bounded and for unbounded groups.

Groups bounded by the calendar (one series) use plain windows. Groups that grow
with the number of series never meet in one task: values are counted first, cut
into ordered buckets, and only bucket totals are put in sequence. The cut points
come from a sketch, but every rank is exact whatever the cut points are.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable
from .clock import as_col

LEAST_BUCKETS = 128


def pearson(x, y) -> Column:
    """Aggregate correlation over complete pairs; NULL below 3 pairs or for a constant side."""
    x, y = as_col(x), as_col(y)
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    varies = (F.count_if(both) >= 3) & (F.min(xs) < F.max(xs)) & (F.min(ys) < F.max(ys))
    spread = F.stddev_pop(xs) * F.stddev_pop(ys)
    return F.when(varies, F.try_divide(F.covar_pop(xs, ys), spread))


def window_average_rank(value, by) -> Column:
    """Average rank inside groups that the calendar bounds."""
    ordered = Window.partitionBy(*by).orderBy(as_col(value))
    ties = F.count("*").over(Window.partitionBy(*by, as_col(value)))
    return F.rank().over(ordered) + (ties - 1) / 2


def _cut_points(df, by, value):
    """Cut points for four buckets per shuffle task, so that buckets do not grow with data that more tasks share."""
    buckets = max(LEAST_BUCKETS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = F.percentile_approx(as_col(value), [i / buckets for i in range(1, buckets)], 20 * buckets)
    return df.groupBy(*by).agg(F.array_distinct(cuts).alias("_cuts"))


def _with_bucket(df, cuts, by, value):
    """Odd buckets hold exactly one value (a cut point), even ones the values between."""
    joined = df.join(cuts, list(by)) if by else df.withColumn("_cuts", cuts.scalar())
    v = as_col(value)
    below = F.size(F.filter("_cuts", lambda c: c < v))
    return joined.withColumn("_bucket", below * 2 + F.array_contains("_cuts", v).cast("int")).drop("_cuts")


def value_counts(df: DataFrame, by, value: str) -> DataFrame:
    """Distinct values with ``n``, rows below (``below``) and group size (``size``).

    Buckets are stored: a sum of doubles or a sketch may come out differently when it is computed again, and the counts
    inside a bucket and the totals of the buckets have to come from one computation.
    """
    by = list(by)
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*by, value).agg(F.count("*").alias("n"))
    bucketed = durable(_with_bucket(counts, _cut_points(counts, by, value), by, value))
    totals = bucketed.groupBy(*by, "_bucket").agg(F.sum("n").alias("_t"))
    # At most two rows per cut point and group reach this window.
    seq = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    totals = totals.withColumns({
        "_before": F.coalesce(F.sum("_t").over(seq.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "size": F.sum("_t").over(seq)}).drop("_t")
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = bucketed.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return ranked.join(totals, [*by, "_bucket"]).select(
        *by, value, "n", (F.col("_before") + F.col("_in")).alias("below"), "size")


def average_ranks(df: DataFrame, by, value: str, out: str) -> DataFrame:
    """Add the exact average rank of ``value``; equal values meet again by an equi-join, so they are stored first."""
    df = durable(df)
    return df.join(_value_ranks(df, by, value, out), [*by, value])


def _value_ranks(df: DataFrame, by, value: str, out: str) -> DataFrame:
    return value_counts(df, by, value).select(*by, value, (F.col("below") + (F.col("n") + 1) / 2).alias(out))


def spearman(df: DataFrame, by, x: str, y: str) -> DataFrame:
    """Pair counts, distinct counts, Pearson and Spearman for groups of any size.

    Pairs are stored before they are ranked: ranks come back by a join on the values, which loses every pair whose value
    is a sum that another run of the same plan adds up in another order.
    """
    by = list(by)
    pairs = durable(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y))
    ranked = pairs.join(_value_ranks(pairs, by, x, "_rx"), [*by, x]).join(_value_ranks(pairs, by, y, "_ry"), [*by, y])
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n_paired"), pearson(x, y).alias("pearson"), pearson("_rx", "_ry").alias("spearman"))


def exact_quantiles(df: DataFrame, by, value: str, probabilities: dict) -> DataFrame:
    """Linear-interpolated quantiles per group, without collecting a group's values."""
    by = list(by)
    counts = value_counts(df, by, value)
    picks = []
    for name, p in probabilities.items():
        h = (F.col("size") - 1) * p
        lo, frac = F.floor(h), h - F.floor(h)
        hit = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
        at_lo = F.max(F.when(hit(lo), F.col(value)))
        at_hi = F.max(F.when(hit(lo + 1), F.col(value)))
        part = F.max(frac)
        picks.append(F.when(part > 0, at_lo + (at_hi - at_lo) * part).otherwise(at_lo).alias(name))
    return counts.groupBy(*by).agg(*picks)


def ordered_positions(df: DataFrame, value: str, key: str, out="position") -> DataFrame:
    """0-based position in the total order (value, key) over the whole table, plus ``size``.

    The table is dealt by ranges of the whole order, key included, so equal values do not pile up in one task; it is
    stored, and only one row count per range is put in sequence.
    """
    dealt = durable(df.repartitionByRange(as_col(value), as_col(key)).withColumn("_p", F.spark_partition_id()))
    seq = Window.partitionBy(F.lit(0))
    totals = dealt.groupBy("_p").agg(F.count("*").alias("_t")).select("_p", F.coalesce(F.sum("_t").over(
        seq.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_t").over(seq).alias("size"))
    inside = Window.partitionBy("_p").orderBy(value, key)
    return dealt.withColumn("_in", F.row_number().over(inside)).join(totals, "_p").withColumn(
        out, F.col("_before") + F.col("_in") - 1).drop("_p", "_before", "_in")
