"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # vector pooling keeps one buffer per bag; allow more bags before it falls back to sorting
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


#: Inputs of at most so many bytes are dealt out over the cores when they come in fewer parts.
SMALL_INPUT = 64 << 20
#: Bytes of a stored input in a part, where the rows of a key are brought together: what is grouped within a part fits in memory.
PART_BYTES = 4 << 20
#: A key with more rows than this is not brought together.
HOT_ROWS = 1000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "bagscope") -> SparkSession:
    """A session for tests and benchmarks with a shared folder of its own; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bagscope-"))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, under ``spark.checkpoint.dir`` as the session names it.

    Without the setting there is no folder that all executors are known to share, which is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/bagscope-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Call it when all results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, as ``schema`` if one is given.

    Used where a result is read more than once or where an iterative job would grow its lineage. The
    table survives the loss of executors, is column-pruned by its readers, and its known size lets
    Catalyst choose join sides. :func:`release` deletes it at the end of the application's work.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A small input in fewer parts than the cluster has cores, dealt out over them; any other input as it is.

    ``df`` is a scan, whose size Spark knows from its files.
    """
    if _scan_bytes(df) > SMALL_INPUT:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """A scan with the rows of each key in one part, in parts of some PART_BYTES, so that what is grouped by the key and more
    columns needs no other shuffle and does not outgrow a task's memory.

    Small inputs are spread. If a key has more than HOT_ROWS rows the input stays as it is, for one part could hold most of it.
    """
    size = _scan_bytes(df)
    if size <= SMALL_INPUT:
        return spread(df, key)
    if not df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS).isEmpty():
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), key)


def _scan_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
