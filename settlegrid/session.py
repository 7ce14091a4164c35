"""Session settings every operator relies on, and the one way to cut lineage."""
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .checks import ContractError


def configure(spark: SparkSession) -> SparkSession:
    """Pin the UTC session zone: local clock columns are derived, never implied."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def build_session(app: str = "settlegrid", master: str | None = None, **conf) -> SparkSession:
    """Session with AQE and Arrow on; sizes are left to the cluster unless passed in ``conf``."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a local master, whose tasks share this machine's
    disk, gets one of its own where that is unset; on a cluster it has to be named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ContractError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A fresh path under the shared folder for a table that outlives one job."""
    return f"{_shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor does not replay the whole chain."""
    _shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` under the shared folder and read it back. Unlike a checkpoint this computes it once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
