"""Stratified folds, splits, class weights and samples, all deterministic and all in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagscope.operators.ranking import first_n_per_group, ordered_index

ID = "repertoire_id"
SEED = 42


def shuffle_key(seed: int = SEED, *columns: str) -> Column:
    """A reproducible shuffle order: md5 of the seed and the id."""
    parts = [F.col(c).cast("string") for c in (columns or (ID,))]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _ranked_within_label(labels: DataFrame, seed: int) -> DataFrame:
    """``rank`` 0, 1, .. of each repertoire within its class, in shuffle order."""
    indexed = ordered_index(
        labels.select(ID, "label").withColumn("__key", shuffle_key(seed)), [F.col("label"), F.col("__key"), F.col(ID)]
    ).drop("__key")
    starts = indexed.groupBy("label").agg(F.min("idx").alias("__start"), F.count(F.lit(1)).alias("n_label"))
    return (
        indexed.join(F.broadcast(starts), "label")  # one row per class
        .withColumn("rank", F.col("idx") - F.col("__start"))
        .drop("idx", "__start")
    )


def stratified_folds(labels: DataFrame, n_folds: int = 5, seed: int = SEED) -> DataFrame:
    """(id, label, fold): shuffled folds whose class sizes differ by at most one."""
    ranked = _ranked_within_label(labels, seed)
    return ranked.select(ID, "label", (F.col("rank") % n_folds).cast("int").alias("fold"))


def holdout_split(labels: DataFrame, test_share: float = 0.2, seed: int = SEED) -> DataFrame:
    """(id, label, part): a stratified train/test split."""
    ranked = _ranked_within_label(labels, seed)
    is_test = F.col("rank") < F.round(F.col("n_label") * F.lit(test_share))
    return ranked.select(ID, "label", F.when(is_test, F.lit("test")).otherwise(F.lit("train")).alias("part"))


def class_weights(labels: DataFrame) -> DataFrame:
    """Balanced weights ``n / (classes * n_class)``."""
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg((F.sum("n") / F.count(F.lit(1))).alias("per_class"))
    return counts.withColumn("weight", total.scalar() / F.col("n"))


def sample_by_label(labels: DataFrame, share: float, seed: int = SEED) -> DataFrame:
    """A stratified random subset of the repertoires, for debugging runs."""
    return holdout_split(labels, share, seed).where(F.col("part") == "test").select(ID, "label")


def sample_ids(ids: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """``n`` random repertoires."""
    return ids.select(ID).orderBy(shuffle_key(seed), F.col(ID)).limit(n)


def sample_sequences(sequences: DataFrame, n: int, key: str = "seq_no", seed: int = SEED) -> DataFrame:
    """``n`` random sequences of every repertoire."""
    order = [shuffle_key(seed, ID, key), F.col(key)]
    return first_n_per_group(sequences, [ID], order, n)
