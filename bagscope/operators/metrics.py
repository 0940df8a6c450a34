"""Scores of predictions, per group, without pulling predictions into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagscope.session import materialize


def roc_auc(predictions: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve per group, ties counted half; null where a class is missing.

    Rows without a score, a NaN score or a label other than 0 and 1 take no part. Equal scores are combined
    first, then put in order by range partitions of group and score. Running counts are taken within a
    partition's share of a group and moved up by the counts of the group's earlier partitions, so neither a
    large group nor clustered scores end in one task.
    """
    keys = list(by) or ["__all"]
    rows = predictions if by else predictions.withColumn("__all", F.lit(1))
    value = F.col(score).cast("double")
    usable = rows.where(value.isNotNull() & ~F.isnan(value) & F.col(label).isin(0, 1))
    by_score = usable.groupBy(*keys, value.alias("__score")).agg(
        F.count_if(F.col(label) == 1).alias("__pos"), F.count_if(F.col(label) == 0).alias("__neg")
    )
    ordered = by_score.repartitionByRange(*keys, "__score").withColumn("__part", F.spark_partition_id())
    ordered = materialize(ordered)
    share = ordered.groupBy("__part", *keys).agg(F.sum("__neg").alias("__share"))  # a row per partition and group
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    share = share.select("__part", *keys, F.coalesce(F.sum("__share").over(earlier), F.lit(0)).alias("__below_part"))
    before = Window.partitionBy("__part", *keys).orderBy("__score").rowsBetween(Window.unboundedPreceding, -1)
    within = ordered.withColumn("__below_in_part", F.coalesce(F.sum("__neg").over(before), F.lit(0)))
    same = F.col("__part") == F.col("__other_part")
    right = share.withColumnRenamed("__part", "__other_part")
    for key in keys:
        right = right.withColumnRenamed(key, f"__other_{key}")
        same = same & F.col(key).eqNullSafe(F.col(f"__other_{key}"))
    joined = within.join(right, same)
    pairs = F.col("__pos") * (F.col("__below_part") + F.col("__below_in_part") + F.col("__neg") / 2)
    auc = F.sum(pairs) / F.nullif(F.sum("__pos") * F.sum("__neg"), F.lit(0)).cast("double")
    out = joined.groupBy(*keys).agg(auc.alias("auc"))
    return out if by else out.select("auc")


def classification_report(
    predictions: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label", threshold: float = 0.5
) -> DataFrame:
    """Accuracy, balanced accuracy, recall of each class and mean score of each class, per group."""
    predicted = (F.col(score) > threshold).cast("int")
    right = (predicted == F.col(label)).cast("double")
    positive, negative = F.col(label) == 1, F.col(label) == 0
    report = predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(right).alias("accuracy"),
        F.avg(F.when(positive, right)).alias("sensitivity"),
        F.avg(F.when(negative, right)).alias("specificity"),
        F.avg(F.when(positive, F.col(score))).alias("mean_score_positive"),
        F.avg(F.when(negative, F.col(score))).alias("mean_score_negative"),
    )
    return report.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def hard_predictions(predictions: DataFrame, score: str = "score", threshold: float = 0.5) -> DataFrame:
    return predictions.withColumn("prediction", (F.col(score) > threshold).cast("int"))


def fold_summary(fold_scores: DataFrame, by: Sequence[str], metric: str = "auc") -> DataFrame:
    """Mean and population std over folds of each candidate."""
    return fold_scores.groupBy(*by).agg(
        F.avg(metric).alias(f"mean_{metric}"), F.stddev_pop(metric).alias(f"std_{metric}")
    )


def grid_winner(summary: DataFrame, metric: str = "mean_auc", order: str = "grid_order") -> DataFrame:
    """The candidate with the highest mean; the first in the grid wins a tie."""
    return summary.orderBy(F.desc(metric), F.asc(order)).limit(1)


def compare_predictions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two prediction tables side by side on ``ID``."""
    return left.select("ID", F.col("label_positive_probability").alias("score_x")).join(
        right.select("ID", F.col("label_positive_probability").alias("score_y")), "ID"
    )


def agreement(compared: DataFrame) -> DataFrame:
    """How closely two prediction tables agree: rows, correlation, largest and mean difference."""
    gap = F.abs(F.col("score_x") - F.col("score_y"))
    return compared.agg(
        F.count(F.lit(1)).alias("n"),
        F.corr("score_x", "score_y").alias("correlation"),
        F.max(gap).alias("max_gap"),
        F.avg(gap).alias("mean_gap"),
    )
