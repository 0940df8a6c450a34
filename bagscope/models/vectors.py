"""From long feature rows to one MLlib vector per repertoire, the last step before a model."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from bagscope.session import materialize

ID = "repertoire_id"
# A vector, and the coefficients of a linear model on the driver, are as wide as the vocabulary.
MAX_WIDTH = 20_000_000


def sparse_vectors(ids: DataFrame, features: DataFrame, width: int, value: str = "value") -> DataFrame:
    """(ids.*, features): a sparse vector for every id, all-zero for those without rows; a stored table.

    ``features`` holds (repertoire_id, idx, value) with each pair once, so a repertoire gathers at most
    ``width`` entries. What is stored is a vector's fields, which are read back as vectors.
    """
    if width > MAX_WIDTH:
        raise ValueError(f"vocabulary of {width} features; raise the count threshold")
    entry = F.struct(F.col("idx").cast("int").alias("i"), F.col(value).cast("double").alias("v"))
    gathered = features.groupBy(ID).agg(F.sort_array(F.collect_list(entry)).alias("__entries"))
    entries = F.coalesce("__entries", F.array().cast("array<struct<i:int,v:double>>"))
    joined = ids.join(gathered, ID, "left").withColumn("__entries", entries)
    fields = [F.lit(0).cast("tinyint").alias("type"), F.lit(max(width, 1)).alias("size"), F.col("__entries.i").alias("indices"), F.col("__entries.v").alias("values")]  # 0: sparse
    schema = StructType([*ids.schema.fields, StructField("features", VectorUDT())])
    return materialize(joined.select(*ids.columns, F.struct(*fields).alias("features")), schema)


def dense_vectors(pooled: DataFrame, column: str) -> DataFrame:
    """Pooled arrays as MLlib vectors."""
    return pooled.withColumn("features", array_to_vector(F.col(column).cast("array<double>"))).drop(column)


def positive_score(predicted: DataFrame) -> Column:
    """Probability of the positive class, whatever kind of model made the predictions."""
    if "score" in predicted.columns:
        return F.col("score")
    return vector_to_array("probability")[1]


def score_with(model, rows: DataFrame) -> DataFrame:
    """(rows without vectors, score)."""
    predicted = model.transform(rows)
    keep = [c for c in rows.columns if c != "features"]
    return predicted.select(*keep, positive_score(predicted).alias("score"))
