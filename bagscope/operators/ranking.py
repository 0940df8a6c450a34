"""Global order without a single-task window: indexes, top-k and per-bag samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagscope.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above the low 33 bits
_ROW_MASK = (1 << _ROW_BITS) - 1
_BINS = 4096
_LOOKS = 6
_FEW = 50_000  # so many rows are ordered without another look


def ordered_index(df: DataFrame, order: Sequence[Column], name: str = "idx") -> DataFrame:
    """Add ``name`` = 0, 1, 2, .. in the given order (make it total for a unique result).

    Rows are range-partitioned and sorted in parallel and written once; each partition's offset is a
    running sum over one row per partition. This replaces ``row_number() over (order by ..)``, which
    would pull all rows into one task.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    stored = materialize(placed).withColumn("__part", F.shiftright("__at", _ROW_BITS))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    return (
        stored.join(F.broadcast(offsets), "__part")  # one row per partition: never more than the tasks
        .withColumn(name, F.col("__offset") + F.col("__at").bitwiseAND(F.lit(_ROW_MASK)))
        .drop("__at", "__part", "__offset")
    )


def top_k(df: DataFrame, score: str, ties: Sequence[str], k: int, name: str = "rank") -> DataFrame:
    """The ``k`` rows with the highest ``score``, ties in ascending order of ``ties``, ranked from 1.

    Null and NaN scores are never ranked; infinite ones are. A histogram finds a cut-off that at least ``k``
    rows reach, and looks again into the bin of the cut-off while that bin holds many more: an outlier or a
    cluster of scores doesn't leave all rows to be ordered. Only rows above the cut-off are then ordered, in
    parallel. ``df`` is read once for each look, so hand in a stored table.
    """
    value = F.atan(F.col(score).cast("double"))  # finite for infinite scores, and in the same order
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    low, high, above = None, None, 0
    for _ in range(_LOOKS):
        inside = rows if low is None else rows.where(value.between(low, high))
        first, last, held = inside.agg(F.min(value), F.max(value), F.count(F.lit(1))).first()
        low = first if low is None else low
        if first is None or first == last or above + held <= max(4 * k, _FEW):
            break
        width = (last - first) / _BINS
        bin_of = F.least(F.floor((value - F.lit(first)) / F.lit(width)), F.lit(_BINS - 1)).cast("int")
        bins = inside.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        for row in bins.orderBy(F.desc("bin")).toLocalIterator():  # <= 4096 rows
            low, high = row["low"], row["high"]
            if above + row["n"] >= k:
                break
            above += row["n"]
    survivors = rows if low is None else rows.where(value >= F.lit(low))
    order = [F.col(score).desc(), *[F.col(c).asc_nulls_first() for c in ties]]
    ranked = ordered_index(survivors, order, name)
    return ranked.where(F.col(name) < k).withColumn(name, F.col(name) + 1)


def first_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, salts: int = 64
) -> DataFrame:
    """First ``n`` rows of every group, exact for groups of any size.

    Each group is first cut to ``n`` rows within ``salts`` slices, so the last step sees at most
    ``n * salts`` rows of a group.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    sliced = df.withColumn("__salt", salt)
    inner = Window.partitionBy(*group, "__salt").orderBy(*order)
    outer = Window.partitionBy(*group).orderBy(*order)
    return (
        sliced.withColumn("__rn", F.row_number().over(inner))
        .where(F.col("__rn") <= n)
        .withColumn("__rn", F.row_number().over(outer))
        .where(F.col("__rn") <= n)
        .drop("__rn", "__salt")
    )
