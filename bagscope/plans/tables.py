"""Stand-ins: how the driver's benchmark tables play the part of repertoires, clones and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagscope.operators.joins import lookup_join
from bagscope.session import dealt_by, spread

TOKEN_SEPARATOR = r"[ \t\r\n]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt_by(table(spark, sf_dir, "documents"), "doc_id")


def sequences(spark: SparkSession, sf_dir: str, part: str | None = None) -> DataFrame:
    """Documents as repertoires: each whitespace token is a sequence.

    ``part`` keeps the labelled ("train") or the other ("test") documents before their text is split.
    """
    texts = documents(spark, sf_dir)
    if part is not None:
        listed = table(spark, sf_dir, "labels").select("doc_id")
        texts = lookup_join(texts, listed, ["doc_id"], "left_semi" if part == "train" else "left_anti")
    return _tokens(texts)


def flagged_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sequences with ``train``, true for those of labelled documents."""
    listed = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("train")).distinct()
    texts = lookup_join(documents(spark, sf_dir), listed, ["doc_id"], "left")
    return _tokens(texts.withColumn("train", F.coalesce("train", F.lit(False))), "train")


def _tokens(texts: DataFrame, *keep: str) -> DataFrame:
    tokens = texts.select(
        F.col("doc_id").alias("repertoire_id"),
        F.explode(F.split("text", TOKEN_SEPARATOR)).alias("junction_aa"),
        F.col("lang").alias("v_call"),
        *keep,
    )
    return tokens.where(F.col("junction_aa") != "").select(
        "repertoire_id", "junction_aa", "v_call", F.right("junction_aa", F.lit(1)).alias("j_call"), *keep
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels: the labelled documents are the training set, the others the test set."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("repertoire_id"), F.col("quality").alias("label"))


def customer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as repertoires and the kinds of part they bought as clones."""
    items = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("repertoire_id"),
            F.col("p_brand").alias("junction_aa"),
            F.col("p_type").alias("v_call"),
            F.col("p_size").cast("string").alias("j_call"),
        )
    )


def customer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment") == "BUILDING"
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("repertoire_id"), segment.cast("int").alias("label")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as sequence vectors: ``label`` is the bag they belong to."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("repertoire_id"), F.col("vec_id").alias("seq_no"), F.col("embedding").alias("vector")
    )
