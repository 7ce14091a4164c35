"""Window specs and run (gaps-and-islands) helpers shared by the operators.

``by`` names the columns that identify one series. All windows of an operator
lead with those columns, so one shuffle on ``by`` serves the whole chain.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from .clock import as_col

UNBOUNDED = Window.unboundedPreceding, Window.unboundedFollowing


def over_series(by, order="pos"):
    return Window.partitionBy(*by).orderBy(order)


def whole(by):
    return Window.partitionBy(*by).rowsBetween(*UNBOUNDED)


def mark_runs(df: DataFrame, flag, by=("series",), order="pos", run="run") -> DataFrame:
    """Number the maximal stretches of equal ``flag`` inside every series."""
    w = over_series(by, order)
    changed = F.coalesce((as_col(flag) != F.lag(as_col(flag)).over(w)).cast("int"), F.lit(1))
    return df.withColumn("_changed", changed).withColumn(
        run, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def previous_known(value, by, order="pos") -> Column:
    return F.last(as_col(value), ignorenulls=True).over(
        over_series(by, order).rowsBetween(Window.unboundedPreceding, -1))


def next_known(value, by, order="pos") -> Column:
    """Mirror of :func:`previous_known`; a growing frame over the reversed order.

    A frame that ends at UNBOUNDED FOLLOWING is re-evaluated for every row, which
    is quadratic in the series length, so the order is reversed instead.
    """
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return F.last(as_col(value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def md5_order(*parts) -> Column:
    """Reproducible pseudo-random order key (same text in any engine that has md5)."""
    return F.md5(F.concat_ws("|", *[as_col(p).cast("string") for p in parts]))


def hash_sample(df: DataFrame, by, n: int, draw: Column) -> DataFrame:
    """The ``n`` rows of every group with the smallest hash text, for groups of any size.

    Rows are counted per hash prefix first (65,536 prefixes); only prefixes up to
    the one that reaches ``n`` go on to be ordered, so no task sees a whole group.
    """
    by = list(by)
    rows = df.withColumn("_draw", draw).withColumn("_prefix", F.substring("_draw", 1, 4))
    counts = rows.groupBy(*by, "_prefix").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_prefix").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("_before", before).where(F.col("_before") < n).groupBy(*by).agg(F.max("_prefix").alias("_last"))
    near = rows.join(last, by).where(F.col("_prefix") <= F.col("_last"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_draw"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_draw", "_prefix", "_last", "_rank")
