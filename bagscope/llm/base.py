"""What the operators share: tables, folds, bounded training samples and batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that Spark hands to a Python task at once. Texts may be very long, so batches are short.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: by rows, and by bytes where this Spark has the setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def balanced_sample(rows: DataFrame, label: str, per_class: int, *order: str, ties: Sequence[str] = ()) -> DataFrame:
    """At most ``per_class`` rows of each value of ``label``, drawn by a hash of the columns ``order``; ``ties`` order equal ones.

    The class sizes are counted first, so that the ranking window only sees rows whose hash is small
    enough to be among the first: about twice ``per_class`` of each class, whatever the class sizes.
    """
    draw = F.pmod(F.xxhash64(*order), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    kept = (
        rows.withColumn("_draw", draw)
        .join(F.broadcast(sizes), label)  # one row per class
        .where(F.col("_draw") * F.col("_n") <= F.lit(2.0 * per_class + 50))
    )
    place = F.row_number().over(Window.partitionBy(label).orderBy("_draw", *order, *ties))
    return kept.withColumn("_place", place).where(F.col("_place") <= per_class).drop("_place", "_draw", "_n")


def arrow_rows(function, schema: pa.Schema):
    """A mapInArrow function from one that maps a batch, given as a dict of lists, to a dict of columns."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(function(batch.to_pydict()), schema=schema)

    return mapped
