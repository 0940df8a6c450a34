"""Vector pooling: tokens to a sequence vector, sequence vectors to a repertoire vector."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POOLINGS = ["mean", "max", "min", "sum", "std", "mean_std"]


def pool_bags(vectors: DataFrame, poolings: Iterable[str] = POOLINGS, by: Sequence[str] = ("repertoire_id",),
              vector_col: str = "vector", copies: str | None = None) -> DataFrame:
    """Element-wise mean, max, min, sum, population std and mean‖std of each bag, in one pass.

    ``copies`` names a column that says how often a row counts, for bags whose equal rows were combined.

    One fixed-size buffer per bag and task is combined before the shuffle, so vectors themselves are never
    shuffled or exploded and a bag with a third of all rows is no heavier than any other.
    """
    wanted = list(poolings)
    unknown = set(wanted) - set(POOLINGS)
    if unknown:
        raise ValueError(f"unknown pooling {sorted(unknown)}")
    needed = {"mean": "mean", "max": "max", "min": "min", "sum": "sum", "std": "std"}
    metrics = {needed[p] for p in wanted if p in needed} | ({"mean", "std"} if "mean_std" in wanted else set())
    vector = array_to_vector(F.col(vector_col).cast("array<double>"))
    weight = F.lit(1.0) if copies is None else F.col(copies).cast("double")
    summary = vectors.groupBy(*by).agg(
        Summarizer.metrics(*sorted(metrics | {"count"})).summary(vector, weight).alias("s"),
        F.sum(weight).alias("__w"),
        F.sum(weight * weight).alias("__squares"),
    )
    w = F.col("__w")
    population = F.sqrt(F.greatest(w - F.col("__squares") / w, F.lit(0.0)) / w)  # (n - 1) / n for single copies

    def array(metric: str) -> Column:
        values = vector_to_array(F.col(f"s.{metric}"))
        return F.transform(values, lambda x: x * population) if metric == "std" else values

    columns = [
        (F.concat(array("mean"), array("std")) if p == "mean_std" else array(p)).alias(p) for p in wanted
    ]
    return summary.select(*by, *columns)


def long_vector(pooled: DataFrame, column: str, by: Sequence[str] = ("repertoire_id",)) -> DataFrame:
    """One row per (bag, dimension) of a pooled column."""
    return pooled.select(*by, F.posexplode(column).alias("dim", "value"))


def pool_tokens(rows: DataFrame, tokens: str = "tokens", special: str = "special") -> DataFrame:
    """Sequence vectors from token vectors: ``cls`` (first token), ``mean`` and ``max`` without the
    special tokens.

    ``tokens`` is an array of vectors per sequence, ``special`` an array of flags. It works row by row, with
    no shuffle; an encoder's token limit bounds the arrays. A sequence of special tokens only has a zero
    mean and a maximum of -1e9, the fill value of masked positions.
    """
    first = F.element_at(F.col(tokens), 1)
    pairs = F.arrays_zip(F.col(tokens).alias("t"), F.col(special).alias("s"))
    kept = F.transform(F.filter(pairs, lambda p: ~p["s"]), lambda p: p["t"].cast("array<double>"))
    zeros = F.transform(first, lambda _: F.lit(0.0))
    floor = F.transform(first, lambda _: F.lit(-1e9))
    n = F.greatest(F.size(kept).cast("double"), F.lit(1e-9))
    total = F.aggregate(kept, zeros, lambda acc, t: F.zip_with(acc, t, lambda a, b: a + b))
    top = F.aggregate(kept, floor, lambda acc, t: F.zip_with(acc, t, lambda a, b: F.greatest(a, b)))
    return rows.select(
        *[c for c in rows.columns if c not in (tokens, special)],
        first.cast("array<double>").alias("cls"),
        F.transform(total, lambda x: x / n).alias("mean"),
        top.alias("max"),
    )
