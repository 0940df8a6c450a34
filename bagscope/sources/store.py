"""Tables kept between runs: features, embeddings, clone statistics, results."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagscope.functions.text import RESULT_COLUMNS
from bagscope.operators.importance import fill_sentinels, union_results


class FeatureStore:
    """Parquet tables under one folder, one per feature set, each with a manifest of what was written.

    A write goes to a folder of its own, and its manifest rows (dataset, settings, rows written) come last, so several may
    run side by side: what a lost job left behind is in no manifest and is never read. A dataset without rows has its manifest row, so it
    is not built again. Of several writes of a dataset under the same settings the last one counts.
    """

    MANIFEST = "dataset string, settings string, n_rows bigint, write_id string, written bigint"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, feature_set: str) -> str:
        return f"{self.folder}/{feature_set}"

    def manifest(self, feature_set: str, settings: str = "") -> DataFrame:
        """The last write of every dataset under these settings; a row per dataset."""
        try:
            listing = self.spark.read.schema(self.MANIFEST).option("recursiveFileLookup", "true")
            rows = listing.parquet(f"{self.path(feature_set)}/manifest")
        except AnalysisException:
            rows = self.spark.createDataFrame([], self.MANIFEST)
        last = F.max_by(F.struct("n_rows", "write_id"), F.struct("written", "write_id")).alias("last")
        return rows.where(F.col("settings") == settings).groupBy("dataset").agg(last).select("dataset", "last.*")

    def present(self, feature_set: str, datasets: Sequence[str], settings: str = "") -> set[str]:
        """Which of the datasets a feature set already holds under these settings, by one look into the manifest."""
        found = self.manifest(feature_set, settings).where(F.col("dataset").isin(list(datasets)))
        return {r["dataset"] for r in found.select("dataset").toLocalIterator()}  # at most the datasets asked for

    def write(self, feature_set: str, rows: DataFrame, datasets: Sequence[str] | None = None, settings: str = "") -> DataFrame:
        """Write rows with a ``dataset`` column, replacing the datasets they contain and those listed."""
        write_id, written = uuid.uuid4().hex, time.time_ns()
        path = f"{self.path(feature_set)}/data/write_id={write_id}"
        rows.write.partitionBy("dataset").parquet(path)
        fields = [f for f in rows.schema.fields if f.name != "dataset"] + [T.StructField("dataset", T.StringType())]
        counted = self.spark.read.schema(T.StructType(fields)).parquet(path).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))
        if datasets is not None:
            listed = self.spark.createDataFrame([(d,) for d in sorted(set(datasets))], "dataset string")
            counted = listed.join(counted, "dataset", "full").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
        entry = counted.select("dataset", F.lit(settings).alias("settings"), "n_rows", F.lit(write_id).alias("write_id"), F.lit(written).alias("written"))
        self.spark.createDataFrame([(T.StructType(fields).json(),)], "value string").coalesce(1).write.text(f"{self.path(feature_set)}/schemas/{write_id}")
        entry.coalesce(1).write.parquet(f"{self.path(feature_set)}/manifest/{write_id}")  # writers side by side don't share a folder
        return self.read(feature_set, settings=settings)

    def read(self, feature_set: str, datasets: Sequence[str] | None = None, settings: str = "") -> DataFrame:
        """The rows of the datasets' last writes; names of datasets are text even where they look like numbers."""
        live = self.manifest(feature_set, settings)
        if datasets is not None:
            live = live.where(F.col("dataset").isin(list(datasets)))
        live = live.select("dataset", "n_rows", "write_id").collect()  # a row per dataset
        if not live:
            raise LookupError(f"nothing is stored of {feature_set!r} under settings {settings!r}")
        root = self.path(feature_set)
        of_schema = max(live, key=lambda r: r["n_rows"])["write_id"]
        fields = T.StructType.fromJson(json.loads(self.spark.read.text(f"{root}/schemas/{of_schema}").first()["value"])).fields
        writes = sorted({r["write_id"] for r in live if r["n_rows"]})
        if not writes:
            return self.spark.createDataFrame([], T.StructType(fields))
        schema = T.StructType([*fields, T.StructField("write_id", T.StringType())])
        table = self.spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*[f"{root}/data/write_id={w}" for w in writes])
        own = self.spark.createDataFrame([(r["dataset"], r["write_id"]) for r in live if r["n_rows"]], "dataset string, write_id string")
        return table.join(F.broadcast(own), ["dataset", "write_id"], "left_semi").drop("write_id")  # a row per dataset

    def ensure(
        self, feature_set: str, datasets: Sequence[str], build: Callable[[list[str]], DataFrame], settings: str = ""
    ) -> DataFrame:
        """Features of ``datasets``, computing in one job only those that are missing under these settings."""
        missing = sorted(set(datasets) - self.present(feature_set, datasets, settings))
        if missing:
            self.write(feature_set, build(missing), missing, settings)
        return self.read(feature_set, datasets, settings)


def save_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated files with a header, written in parallel."""
    df.write.mode("overwrite").options(sep="\t", header="true", quote='"', escape='"').csv(path)


def save_predictions(predictions: DataFrame, path: str) -> None:
    """Result rows as TSV; writing no predictions at all is an error."""
    if predictions.isEmpty():
        raise ValueError("no predictions to save")
    save_tsv(fill_sentinels(predictions), path)


def save_important_sequences(sequences: DataFrame, path: str) -> None:
    save_tsv(fill_sentinels(sequences), path)


def save_submission(predictions: Sequence[DataFrame], sequences: Sequence[DataFrame], path: str) -> None:
    """Predictions first, then important sequences, as CSV in a reproducible order.

    Files are range-partitioned by that order, so part files read in name order give the sequence. With
    nothing to write the result is an empty table with its header.
    """
    parts = [*predictions, *sequences]
    if not parts:
        raise ValueError("pass at least one (possibly empty) result table")
    combined = union_results(predictions, sequences)
    rank = F.regexp_extract("ID", r"_seq_top_(\d+)$", 1).try_cast("long")
    ordered = combined.orderBy("section", "dataset", F.when(F.col("section") == 1, rank), "ID")
    filled = fill_sentinels(ordered)
    filled.select(*RESULT_COLUMNS).write.mode("overwrite").options(header="true", quote='"', escape='"').csv(path)


def save_clone_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").parquet(path)
