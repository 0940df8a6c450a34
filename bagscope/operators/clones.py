"""Public clones: presence per repertoire, class counts, exact enrichment, selection and lookup.

A clone is the triple (junction_aa, v_call, j_call); a repertoire is a set of clones. Null parts are
kept, so every join on clones is null-safe.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagscope.functions.stats import fisher_greater
from bagscope.functions.text import CLONE_COLUMNS
from bagscope.operators.joins import lookup_join
from bagscope.operators.ranking import ordered_index

ID = "repertoire_id"


@dataclass(frozen=True)
class Gate:
    """Enrichment thresholds: at least ``min_pos`` positives, at most ``max_neg`` negatives (None: any
    number) and a p-value strictly below ``p_cut``."""

    min_pos: int = 3
    max_neg: int | None = 0
    p_cut: float = 0.05


def clone_presence(sequences: DataFrame, by: Sequence[str] = (ID,)) -> DataFrame:
    """Distinct (repertoire, clone). Hashing all columns spreads a clone that everyone has."""
    return sequences.select(*by, *CLONE_COLUMNS).distinct()


def distinct_clones(sequences: DataFrame) -> DataFrame:
    return sequences.select(*CLONE_COLUMNS).distinct()


def class_totals(labels: DataFrame) -> DataFrame:
    """One row: how many positive and negative repertoires there are."""
    return labels.agg(
        F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg")
    )


def clone_counts(presence: DataFrame, labels: DataFrame) -> DataFrame:
    """Positive and negative repertoires that hold each clone, for clones seen in a positive one.

    Labels join on the map side; conditional counts take one shuffle, combined before it.
    """
    labelled = lookup_join(presence, labels.select(ID, "label"), [ID])
    counted = labelled.groupBy(*CLONE_COLUMNS).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    return counted.where(F.col("pos") > 0)


def clone_stats(counts: DataFrame, labels: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """Every counted clone with its p-value and the first reason for dropping it, or "kept".

    The p-value is computed only behind the two cheap gates, and is null where they already drop a clone.
    """
    totals = class_totals(labels)
    with_totals = counts.withColumn("__np", totals.select("n_pos").scalar()).withColumn(
        "__nn", totals.select("n_neg").scalar()
    )
    return _tested(with_totals, gate)


def _tested(with_totals: DataFrame, gate: Gate) -> DataFrame:
    rare = F.col("pos") < gate.min_pos
    common = F.lit(False) if gate.max_neg is None else F.col("neg") > gate.max_neg
    p = F.when(~rare & ~common, fisher_greater(F.col("pos"), F.col("neg"), F.col("__np"), F.col("__nn")))
    reason = (
        F.when(rare, F.lit("too_rare"))
        .when(common, F.lit("too_common"))
        .when(F.col("p_value") >= gate.p_cut, F.lit("not_significant"))
        .otherwise(F.lit("kept"))
    )
    return with_totals.withColumn("p_value", p).withColumn("reason", reason).drop("__np", "__nn")


def fold_clone_counts(presence: DataFrame, folds: DataFrame, n_folds: int) -> DataFrame:
    """(fold, clone, pos, neg): the counts of every training set, that is of all folds but one.

    ``folds`` is (repertoire_id, label, fold). Each clone is counted once by fold and class, in one shuffle of the
    presence; a training set's counts are the clone's totals less those of the fold held out. Only clones seen in a
    positive repertoire of the training set are given.
    """
    labelled = lookup_join(presence, folds.select(ID, "label", "fold"), [ID])
    cells = [
        F.count_if((F.col("label") == label) & (F.col("fold") == fold)).alias(f"__{name}_{fold}")
        for name, label in (("pos", 1), ("neg", 0)) for fold in range(n_folds)
    ]
    counted = labelled.groupBy(*CLONE_COLUMNS).agg(
        F.count_if(F.col("label") == 1).alias("__pos"), F.count_if(F.col("label") == 0).alias("__neg"), *cells
    )
    left = [
        F.struct(F.lit(fold).alias("fold"), *[(F.col(f"__{name}") - F.col(f"__{name}_{fold}")).alias(name) for name in ("pos", "neg")])
        for fold in range(n_folds)
    ]
    return counted.select(*CLONE_COLUMNS, F.inline(F.array(*left))).where(F.col("pos") > 0)


def fold_class_totals(folds: DataFrame) -> DataFrame:
    """(fold, n_pos, n_neg) of the training set of each fold; one row per fold."""
    held = folds.groupBy("fold").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    every = class_totals(folds)
    return held.select(
        "fold", (every.select("n_pos").scalar() - F.col("p")).alias("n_pos"), (every.select("n_neg").scalar() - F.col("n")).alias("n_neg")
    )


def fold_clone_stats(counts: DataFrame, folds: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """As :func:`clone_stats`, for the counts of every fold's training set."""
    totals = fold_class_totals(folds).select("fold", F.col("n_pos").alias("__np"), F.col("n_neg").alias("__nn"))
    return _tested(counts.join(F.broadcast(totals), "fold"), gate)  # one row per fold


def kept_clones(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("reason") == "kept").drop("reason")


def index_clones(selected: DataFrame) -> DataFrame:
    """Column number of each selected clone, in clone order."""
    return ordered_index(selected, [F.col(c).asc_nulls_first() for c in CLONE_COLUMNS], "idx")


def first_clones(indexed: DataFrame, n: int) -> DataFrame:
    return indexed.where(F.col("idx") < n)


def funnel(stats: DataFrame) -> DataFrame:
    """One row: clones checked, dropped for each reason, and kept."""
    def counted(reason: str) -> Column:
        return F.count_if(F.col("reason") == reason).alias(reason)

    return stats.agg(
        F.count(F.lit(1)).alias("checked"),
        *[counted(r) for r in ("too_rare", "too_common", "not_significant", "kept")],
    )


def strongest(stats: DataFrame, n: int) -> DataFrame:
    """The ``n`` kept clones with the smallest p-values, for a report."""
    return kept_clones(stats).orderBy("p_value", *CLONE_COLUMNS).limit(n)


def clone_matrix(rows: DataFrame, indexed: DataFrame) -> DataFrame:
    """Which selected clones each repertoire holds, as distinct (repertoire, idx) rows.

    ``rows`` are sequences or their presence; the selected clones are looked up before anything is made distinct.
    """
    chosen = indexed.select(*CLONE_COLUMNS, "idx")
    return lookup_join(rows.select(ID, *CLONE_COLUMNS), chosen, CLONE_COLUMNS, null_safe=True).select(ID, "idx").distinct()


def clone_frequency(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Occurrences of each clone in positive repertoires: pass sequences to count every copy, or
    :func:`clone_presence` to count repertoires."""
    positive = labels.where(F.col("label") == 1).select(ID)
    held = lookup_join(rows.select(ID, *CLONE_COLUMNS), positive, [ID], "left_semi")
    return held.groupBy(*CLONE_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
