"""Typing, signing and latest-revision resolution of meter records."""
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from ..checks import guard

KEY = ["series", "settle_date", "period"]
REVISION = ["rev_agg", "rev_flow", "rev_run"]


def _yyyymmdd(name):
    return F.try_to_timestamp(F.col(name), F.lit("yyyyMMdd")).cast("date")


def record_violations(raw) -> dict:
    """Named row rules over text records; a NULL volume is allowed, everything else is not."""
    number = lambda c: F.col(c).try_cast("double")
    bad_number = lambda c: number(c).isNull() | F.isnan(number(c)) | (F.abs(number(c)) == float("inf"))
    return {
        "missing_series": F.col("series").isNull(),
        "missing_date": F.col("settle_date").isNull(),
        "bad_date": F.col("settle_date").isNotNull() & _yyyymmdd("settle_date").isNull(),
        "bad_period": bad_number("period") | (number("period") % 1 != 0),
        "bad_volume": F.col("volume").isNotNull() & bad_number("volume"),
        "bad_revision": _yyyymmdd("rev_agg").isNull() | _yyyymmdd("rev_flow").isNull() | bad_number("rev_run"),
    }


def parse_records(raw: DataFrame) -> DataFrame:
    """Text records to typed records; a broken row stops the job where it is read."""
    rules = record_violations(raw)
    broken = lambda *names: F.coalesce(reduce(or_, [rules[n] for n in names]), F.lit(False))
    keep = [c for c in ("source",) if c in raw.columns]
    return raw.select(
        guard(F.col("series"), broken("missing_series"), "Record without a series id", "string").alias("series"),
        guard(_yyyymmdd("settle_date"), broken("missing_date", "bad_date"), "Unreadable settlement date",
              "date").alias("settle_date"),
        guard(F.col("period").try_cast("double").cast("int"), broken("bad_period"),
              "Settlement period is not a whole number", "int").alias("period"),
        guard(F.col("volume").try_cast("double"), broken("bad_volume"), "Non-finite volume",
              "double").alias("volume"),
        "flow",
        guard(_yyyymmdd("rev_agg"), broken("bad_revision"), "Invalid revision", "date").alias("rev_agg"),
        _yyyymmdd("rev_flow").cast("timestamp").alias("rev_flow"),
        F.col("rev_run").try_cast("double").alias("rev_run"),
        F.coalesce(F.col("estimated") == "T", F.lit(False)).alias("estimated"), *keep)


def sign_volumes(records: DataFrame) -> DataFrame:
    """Imports positive, exports negative; raw volumes must be unsigned with a known flag."""
    known = F.coalesce(F.col("flow").isin("I", "E"), F.lit(False))
    signed = F.when(F.col("flow") == "E", -F.col("volume")).otherwise(F.col("volume"))
    signed = guard(signed, F.coalesce(F.col("volume") < 0, F.lit(False)),
                   "Volume must be unsigned before direction conversion", "double")
    return records.withColumn("volume", guard(signed, ~known, "Unknown or missing direction flag", "double"))


def _reversed(text):
    """Text whose order is the reverse of ``text``'s: complemented hex digits and an end mark; NULL comes last of all."""
    digits = "0123456789ABCDEF"
    return F.coalesce(F.concat(F.translate(F.hex(text), digits, digits[::-1]), F.lit("G")), F.lit("H"))


def latest_candidates(records: DataFrame, key=KEY, revision=REVISION, value="volume", flow="flow",
                      keep=("estimated",)) -> DataFrame:
    """Newest revision of every key, and whether its tied rows disagree.

    ``max`` over structs combines on the map side, so a key (or a series) that
    holds a large share of the raw rows is reduced before the single shuffle. Tied
    rows agree when the largest and the smallest pair of value and direction at the
    newest revision are the same; NULL counts as a value of its own and sorts first.
    """
    rev = [F.col(c) for c in revision]
    direction = F.col(flow) if flow else F.lit(None).cast("string")
    g = records.groupBy(*key).agg(
        F.max(F.struct(*rev, F.col(value).alias("v"), direction.alias("f"), *[F.col(c) for c in keep])).alias("top"),
        F.max(F.struct(*rev, F.col(value).isNull().alias("none"), (-F.col(value)).alias("v"), _reversed(direction).alias("f"))).alias("low"),
        F.count("*").alias("n_rows"))
    same = F.col("top.v").eqNullSafe(-F.col("low.v")) & _reversed(F.col("top.f")).eqNullSafe(F.col("low.f"))
    return g.select(*key, *[F.col(f"top.{c}").alias(c) for c in revision], F.col("top.v").alias(value),
                    F.col("top.f").alias("flow"), *[F.col(f"top.{c}").alias(c) for c in keep], "n_rows", (~same).alias("conflict"))


def resolve_revisions(records: DataFrame, **options) -> DataFrame:
    """One row per key at its newest revision; a contradiction at that revision is an error."""
    value = options.get("value", "volume")
    c = latest_candidates(records, **options)
    return c.withColumn(value, guard(F.col(value), F.col("conflict"),
                                     "Conflicting volume or direction among rows of the newest revision", "double")).drop("conflict")


def conflicting_keys(records: DataFrame, **options) -> DataFrame:
    """Keys whose newest revision carries several volumes or directions."""
    return latest_candidates(records, **options).where("conflict")
