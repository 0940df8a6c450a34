"""Choosing and applying ensemble weights: small tables of two or three models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRONG_WEIGHT = 0.5


def normalized_weights(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each weight over the sum of absolute weights."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return weights.withColumn("norm_weight", F.col("weight") / F.sum(F.abs("weight")).over(group))


def select_weights(
    weights: DataFrame, dataset_type: str, method: str = "hybrid", top_n: int = 2, by: Sequence[str] = ()
) -> DataFrame:
    """Final ensemble weights from ``(model, model_order, weight, auc)``, one to three rows per group.

    *synthetic*: one model takes all. ``weights`` picks the largest absolute weight, ``cv`` the best AUC,
    ``hybrid`` the former if its normalised size passes one half and the latter otherwise.
    *experimental*: the ``top_n`` positive weights, rescaled to sum to one; the largest absolute weight if
    none is positive. Ties go to the first model.
    """
    if dataset_type not in ("synthetic", "experimental") or method not in ("weights", "cv", "hybrid"):
        raise ValueError(f"unknown rule {dataset_type!r} / {method!r}")
    keys = list(by) or [F.lit(1)]
    group = Window.partitionBy(*keys)
    ranked = normalized_weights(weights, by)
    by_weight = Window.partitionBy(*keys).orderBy(F.desc("__size"), F.asc("model_order"))
    by_auc = Window.partitionBy(*keys).orderBy(F.desc("auc"), F.asc("model_order"))
    ranked = (
        ranked.withColumn("__size", F.abs("norm_weight"))
        .withColumn("__weight_rank", F.row_number().over(by_weight))
        .withColumn("__auc_rank", F.row_number().over(by_auc))
        .withColumn("__largest", F.max("__size").over(group))
    )
    best_weight = (F.col("__weight_rank") == 1).cast("double")
    best_auc = (F.col("__auc_rank") == 1).cast("double")
    if dataset_type == "synthetic":
        chosen = {
            "weights": best_weight,
            "cv": best_auc,
            "hybrid": F.when(F.col("__largest") > STRONG_WEIGHT, best_weight).otherwise(best_auc),
        }[method]
        out = ranked.withColumn("final_weight", chosen)
    else:
        positive = F.greatest(F.col("weight"), F.lit(0.0))
        by_positive = Window.partitionBy(*keys).orderBy(F.desc("__positive"), F.asc("model_order"))
        out = (
            ranked.withColumn("__positive", positive)
            .withColumn("__taken", F.when(F.row_number().over(by_positive) <= top_n, F.col("__positive")).otherwise(0.0))
            .withColumn("__sum", F.sum("__taken").over(group))
            .withColumn(
                "final_weight", F.when(F.col("__sum") > 0, F.col("__taken") / F.col("__sum")).otherwise(best_weight)
            )
        )
    return out.select(*weights.columns, "norm_weight", "final_weight")


def blend(scores: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """Weighted sum of score columns."""
    total = F.lit(0.0)
    for column, weight in weights.items():
        total = total + F.col(column) * F.lit(float(weight))
    return scores.withColumn(name, total)
