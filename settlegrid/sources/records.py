"""Meter record files: scan, filters, inventory, zone map."""
import csv

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..checks import ContractError, require_columns

# Header names of the meter record files.
COLUMNS = {
    "series": "GSP Id", "settle_date": "Settlement Date", "period": "Settlement Period",
    "rev_agg": "Date of Aggregation", "rev_flow": "Flow Run Date", "rev_run": "CDCA Run Number",
    "volume": "Meter Volume", "flow": "Import/Export Indicator", "estimated": "Estimate Indicator",
}
OPTIONAL = "estimated"
DIRECTIONS = ("I", "E", "signed_net")


def read_raw(spark: SparkSession, paths, headers: dict | None = None) -> DataFrame:
    """Read record files as text columns, whatever their column order.

    Every entry of ``paths`` (file, folder or glob) shares one header, of which
    Spark reads the first line only; ``headers`` names those already known. Entries
    with equal headers become one scan. ``enforceSchema=false`` makes a file with
    another header inside an entry fail instead of being read by position.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ContractError("No meter record sources")
    by_header = {}
    for path in paths:
        names = (headers or {}).get(path) or spark.read.option("header", True).csv(path).columns
        by_header.setdefault(tuple(names), []).append(path)
    out = None
    for names, group in by_header.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        part = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(group)
        require_columns(part, [v for k, v in COLUMNS.items() if k != OPTIONAL])
        if COLUMNS[OPTIONAL] not in names:
            part = part.withColumn(COLUMNS[OPTIONAL], F.lit(None).cast("string"))
        part = part.select(*[F.col(f"`{v}`").alias(k) for k, v in COLUMNS.items()],
                           F.input_file_name().alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


def by_settlement_date(records: DataFrame, start: str, end: str) -> DataFrame:
    """Keep settlement dates ``start``..``end``; file names say nothing about dates."""
    if dict(records.dtypes)["settle_date"] == "string":
        lo, hi = start.replace("-", ""), end.replace("-", "")
        return records.where(F.col("settle_date").between(lo, hi))
    return records.where(F.col("settle_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def by_direction(records: DataFrame, direction: str) -> DataFrame:
    if direction not in DIRECTIONS:
        raise ContractError("Unknown direction: use I, E or signed_net")
    return records if direction == "signed_net" else records.where(F.col("flow") == direction)


def load_records(spark, paths, start, end, direction="I", zones: DataFrame | None = None, check_digests=False) -> DataFrame:
    """Records of the wanted settlement dates and direction; none at all is an error.

    With ``zones`` (a stored :func:`zone_map`) only its sources whose dates touch the request are opened, after a look at
    whether they are still the files that were mapped; ``paths`` may then be None.
    """
    if zones is None:
        raw = read_raw(spark, paths)
    else:
        wanted = sources_in_window(zones, start.replace("-", ""), end.replace("-", "")).collect()  # one short row per file
        if not wanted:
            raise ContractError(f"No source holds a settlement date from {start} to {end}")
        refuse_changed(spark, wanted, check_digests)
        raw = read_raw(spark, [r["source"] for r in wanted], {r["source"]: r["header"] for r in wanted})
    out = by_direction(by_settlement_date(raw, start, end), direction)
    if not out.take(1):
        raise ContractError(f"The sources hold nothing for direction {direction} between {start} and {end}")
    return out


def _plain(path):
    """A file's place as the reader takes it: paths come back from scans with their special characters escaped."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def _facts(lines: DataFrame) -> DataFrame:
    """Per file: length, time of its last change, header line, and a digest of its lines that no order of reading changes."""
    m = F.col("_metadata")
    rows = lines.select(_plain(m["file_path"]).alias("source"), m["file_size"].alias("length"), m["file_modification_time"].alias("modified"), "value")
    head = F.when(F.contains("value", F.lit(COLUMNS["series"])) & F.contains("value", F.lit(COLUMNS["settle_date"])), F.col("value"))
    return rows.groupBy("source").agg(
        F.first("length").alias("length"), F.first("modified").alias("modified"), F.min(head).alias("_head"),
        F.concat_ws("-", F.count("*"), F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("value", F.lit(1)))).alias("digest"))


def zone_map(spark: SparkSession, paths) -> DataFrame:
    """One row per source file: source, settlement_start and _end (as in the files), rows, length, modified, digest, header.

    Two scans of the sources, to be stored (``write_table``) and given to :func:`load_records` from then on.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    facts = _facts(spark.read.text(paths))
    heads = {r["source"]: next(csv.reader([r["_head"]])) for r in facts.select("source", "_head").collect() if r["_head"]}  # one line per file
    raw = read_raw(spark, sorted(heads), heads) if heads else None
    if raw is None:
        raise ContractError("No meter record sources")
    spans = source_spans(source_coverage(raw.withColumn("source", _plain(F.col("source")))))
    names = spark.createDataFrame(sorted(heads.items()), "source string, header array<string>")
    return facts.drop("_head").join(names, "source").join(spans, "source")


def refuse_changed(spark: SparkSession, wanted, check_digests=False) -> None:
    """Raise unless the files are those that were mapped.

    Lengths and times come from the file listing alone. A file of the same length and another time, such as a copy, is
    read for its digest; ``check_digests`` does so for every file.
    """
    m = F.col("_metadata")
    places = [r["source"] for r in wanted]
    found = spark.read.format("binaryFile").load(places).select(_plain(m["file_path"]).alias("source"), m["file_size"].alias("length"),
                                                                m["file_modification_time"].alias("modified"))
    now = {r["source"]: r for r in found.collect()}
    changed = [r["source"] for r in wanted if r["source"] not in now or now[r["source"]]["length"] != r["length"]]
    doubtful = [r for r in wanted if r["source"] not in changed and (check_digests or now[r["source"]]["modified"] != r["modified"])]
    if doubtful and not changed:
        digests = {r["source"]: r["digest"] for r in _facts(spark.read.text([r["source"] for r in doubtful])).collect()}
        changed = [r["source"] for r in doubtful if digests.get(r["source"]) != r["digest"]]
    if changed:
        raise ContractError(f"Sources are not what was mapped: {sorted(changed)}")


def source_coverage(records: DataFrame) -> DataFrame:
    """Raw rows of every (source, settlement date)."""
    return records.groupBy("source", "settle_date").agg(F.count("*").alias("raw_rows"))


def source_spans(coverage: DataFrame) -> DataFrame:
    """First and last settlement date and row total of every source."""
    return coverage.groupBy("source").agg(
        F.sum("raw_rows").alias("rows"), F.min("settle_date").alias("settlement_start"),
        F.max("settle_date").alias("settlement_end"))


def date_coverage(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("settle_date").agg(F.sum("raw_rows").alias("raw_rows"))


def sources_in_window(spans: DataFrame, start, end) -> DataFrame:
    """Sources whose date range touches the request; the others need not be read."""
    return spans.where((F.col("settlement_end") >= start) & (F.col("settlement_start") <= end))
