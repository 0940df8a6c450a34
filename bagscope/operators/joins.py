"""Key joins against lookup tables whose size is measured, not assumed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagscope.session import materialize

BROADCAST_ROWS = 4_000_000
BROADCAST_BYTES = 256 * 1024 * 1024
HOT_ROWS = 2_000_000  # rows of one key that are worth several tasks
SALTS = 64


def measured_size(table: DataFrame) -> tuple[int, int]:
    """Rows and approximate in-memory bytes of ``table``, by one aggregate over it."""
    width = F.lit(16)
    for field in table.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(col), F.lit(0)) + 8
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            width = width + F.greatest(F.size(col), F.lit(0)) * 32
        else:
            width = width + 16
    rows, size = table.agg(F.count(F.lit(1)), F.sum(width.cast("long"))).first()
    return rows, size or 0


def fits_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    n, b = measured_size(table)
    return n <= rows and b <= size


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool, salted: bool) -> DataFrame:
    condition = F.lit(True)
    for key in keys:
        one, other = F.col(key), F.col(f"__{key}")
        condition = condition & (one.eqNullSafe(other) if null_safe else one == other)
    if salted:
        condition = condition & (F.col("__salt") == F.col("__salt_r"))
    return left.join(right, condition, how).drop(*[f"__{key}" for key in keys], "__salt", "__salt_r")


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    null_safe: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join many ``rows`` to a keyed ``table`` (one row per key), which is best read from storage.

    A table within the broadcast bound is broadcast, so ``rows`` is not shuffled. Beyond it, keys with more
    than ``hot_rows`` rows are measured: their rows alone are joined on a salted key, with their table rows
    repeated ``salts`` times, and all other rows take an ordinary join. ``how`` may be any join that keeps
    the left side as it is: inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    keys = list(on)
    right = table
    for key in keys:
        right = right.withColumnRenamed(key, f"__{key}")
    if fits_broadcast(table, rows=broadcast_rows):
        return _matched(rows, F.broadcast(right), keys, how, null_safe, False)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    hot = materialize(counted.select(*[F.col(key).alias(f"__{key}") for key in keys]))  # at most rows / hot_rows keys
    if hot.isEmpty():
        return _matched(rows, right, keys, how, null_safe, False)
    few = fits_broadcast(hot)
    listed = F.broadcast(hot) if few else hot
    cold = _matched(rows, listed, keys, "left_anti", True, False)
    heated = _matched(rows, listed, keys, "left_semi", True, False)
    spread_by = [c for c in rows.columns if c not in keys and not isinstance(
        rows.schema[c].dataType, (T.MapType, T.UserDefinedType))] or keys
    heated = heated.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    condition = F.lit(True)
    renamed = hot.select(*[F.col(f"__{key}").alias(f"__hot_{key}") for key in keys])
    for key in keys:
        condition = condition & F.col(f"__{key}").eqNullSafe(F.col(f"__hot_{key}"))
    few_right = right.join(F.broadcast(renamed) if few else renamed, condition, "left_semi")
    few_right = few_right.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return _matched(cold, right, keys, how, null_safe, False).unionByName(_matched(heated, few_right, keys, how, null_safe, True))
