"""Panel tables: source choice, contract, sinks."""
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..checks import ContractError
from ..operators.panel import OBSERVED


def observed_only(filled: DataFrame) -> DataFrame:
    """Undo fills: keep a cell only when its provenance is an observed kind."""
    return filled.withColumn("value", F.when(F.col("source").isin(OBSERVED), F.col("value")))


def read_panel(spark: SparkSession, observed_path: str | None = None, filled_path: str | None = None) -> DataFrame:
    """Prefer the observed panel; otherwise blank out retrospective fills."""
    if observed_path is not None:
        return spark.read.parquet(observed_path)
    if filled_path is None:
        raise ContractError("Require an observed or a filled panel")
    return observed_only(spark.read.parquet(filled_path))


def contract_report(panel: DataFrame, by="series") -> DataFrame:
    """One row of contract violation counts: ids, alignment, contiguity, duplicates, infinities.

    Repeats are counted per (series, ts) first, with map-side combining, so a
    broken source that repeats one series without end stays spread out; holes
    follow from the span, with no ordering at all.
    """
    slots = panel.groupBy(by, "ts").agg(F.count("*").alias("n"), F.count_if(F.abs("value") == float("inf")).alias("inf"))
    off = (F.unix_micros("ts") % 1_800_000_000) != 0
    span = (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / 1800 + 1
    per = slots.groupBy(by).agg(
        F.count("*").alias("slots"), F.sum(F.col("n") - 1).alias("repeated"), F.count_if(off).alias("unaligned"),
        F.sum("inf").alias("infinite"), (span.cast("long") - F.count_if(~off)).alias("absent"))
    return per.agg(
        F.count("*").alias("n_series"), F.count_if(F.col(by).isNull()).alias("null_ids"),
        F.sum("repeated").alias("duplicate_slots"), F.sum("absent").alias("absent_slots"),
        F.sum("unaligned").alias("unaligned"), F.sum("infinite").alias("infinite"),
        (F.max("slots") - F.min("slots")).alias("ragged_slots"))


def check_panel(panel: DataFrame) -> DataFrame:
    row = contract_report(panel).first().asDict()
    broken = {k: v for k, v in row.items() if k != "n_series" and v}
    if not row["n_series"] or broken:
        raise ContractError(f"Panel contract broken: {broken or 'empty panel'}")
    return panel


def write_table(df: DataFrame, path: str, partition_by=()) -> str:
    """Parquet sink that refuses to overwrite.

    Rows of one folder are brought together and cut into tasks of the advised size by a rebalance: neither one
    task for a large folder nor one small file per task and folder.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_run(tables: dict, root: str) -> dict:
    """Panel, provenance, mask, quality, audit ... one parquet folder per name."""
    return {name: write_table(df, f"{root}/{name}") for name, df in tables.items()}


def write_cases(cases: DataFrame, path: str) -> str:
    """All origins of a study in one job, laid out by model and origin."""
    return write_table(cases.withColumn("origin_day", F.to_date("origin")), path, ("model", "origin_day"))


COMMIT = "origin_pos int, rows long, settings string"


def committed_origins(spark: SparkSession, root: str) -> dict:
    """{origin: (rows, settings)} of the origins whose entry stands; an entry is one short row."""
    try:
        found = spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{root}/commits").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r["origin_pos"]: (r["rows"], r["settings"]) for r in found}


def append_origins(spark: SparkSession, root: str, origins, cases_of, settings: str = "") -> list:
    """Write a study's case rows one origin at a time; returns the origins written by this call.

    ``cases_of(origin)`` gives the rows of one origin. They are written first and the origin's entry in the manifest last,
    so a run that ends in between leaves no entry. A later run skips what is committed and writes the rest over whatever
    was left there. Origins committed under other ``settings`` are refused: one table never mixes two studies.
    """
    done = committed_origins(spark, root)
    others = {o: s for o, (_, s) in done.items() if s != settings}
    if others:
        raise ContractError(f"Origins {sorted(others)} were written with other settings")
    written = []
    for origin in origins:
        if origin in done:
            continue
        place = f"{root}/cases/origin_pos={origin}"
        cases_of(origin).drop("origin_pos").write.mode("overwrite").parquet(place)
        rows = spark.read.parquet(place).count()
        entry = spark.createDataFrame([(origin, rows, settings)], COMMIT).coalesce(1)
        entry.write.mode("overwrite").parquet(f"{root}/commits/entry-{origin}")
        written.append(origin)
    return written


def read_origins(spark: SparkSession, root: str) -> DataFrame:
    """The case rows of the committed origins; folders without an entry are not opened."""
    done = committed_origins(spark, root)
    if not done:
        raise ContractError("No origin is committed")
    return spark.read.option("basePath", f"{root}/cases").parquet(*[f"{root}/cases/origin_pos={o}" for o in sorted(done)])


def write_monthly_temperature(temperature: DataFrame, path: str) -> str:
    monthly = temperature.withColumn("month", F.date_format("ts", "yyyy-MM"))
    return write_table(monthly, path, ("month",))
