"""Temperature mixing of sources: exponentiated token shares, realised as budgeted block permutations.

Built-in expressions only. The table of sources stays distributed; the driver holds two numbers of the
bisection at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagscope.session import materialize

WORD = r"[^ \t\n\x0B\f\r]+"
#: Leading hex digits of a permutation key that make a bin.
BIN_DIGITS = 3
#: Plans of at most so many sources are broadcast; larger ones are joined by an ordinary join.
BROADCAST_SOURCES = 20_000


@dataclass(frozen=True)
class Settings:
    """Exactly one of ``entropy`` (share of the largest possible) and ``repetition`` is the target.

    The budget of tokens is the least that gives every source ``epochs`` whole blocks, so no document is
    left out; ``repetition`` limits how often the tokens of any source are seen, relative to that.
    """

    entropy: float | None = None
    repetition: float | None = 2.0
    epochs: int = 1
    steps: int = 30
    seed: int = 5


def tokens(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _totals(slim: DataFrame) -> DataFrame:
    return materialize(slim.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("rows")))


def exponent(totals: DataFrame, settings: Settings = Settings()) -> float:
    """The exponent in [0, 1], found by bisection, that meets the target; 1 leaves the shares as they are.

    A smaller exponent evens the sources out, which raises the entropy and the repetitions of small sources.
    For ``entropy`` it is the largest that reaches the target, for ``repetition`` the smallest that keeps
    within the limit. Each step is one aggregate over the sources with tokens.
    """
    if (settings.entropy is None) == (settings.repetition is None):
        raise ValueError("state either an entropy or a repetition limit")
    some = totals.where("total > 0")
    first = some.agg(F.sum("total").alias("n"), F.count("*").alias("k"), F.min("total").alias("low"), F.max("total").alias("high")).first()
    if first.k < 2:
        return 1.0
    share = F.col("total") / F.lit(float(first.n))

    def holds(a: float) -> bool:
        if settings.repetition is not None:
            return (first.low / first.high) ** (a - 1) * settings.epochs <= settings.repetition
        weight = F.pow(share, F.lit(a))
        sums = some.agg(F.sum(weight).alias("s"), F.sum(weight * F.log(share)).alias("t")).first()
        return math.log(sums.s) - a * sums.t / sums.s < settings.entropy * math.log(first.k)

    low, high = 0.0, 1.0
    if holds(low):
        return low if settings.repetition is not None else high if not holds(high) else low
    for _ in range(settings.steps):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high if settings.repetition is not None else low


def quotas(totals: DataFrame, a: float, settings: Settings = Settings()) -> DataFrame:
    """source, total, weight, quota, full (whole blocks) and rest (tokens of the last, partial block).

    A source without tokens has weight and quota 0 and gives its documents ``epochs`` times.
    """
    some = totals.where("total > 0")
    first = some.agg(F.sum("total").alias("n"), F.max("total").alias("high")).first()
    n, high = float(first.n or 1), float(first.high or 1)
    scale = some.agg(F.sum(F.pow(F.col("total") / F.lit(n), F.lit(a))).alias("s")).first().s or 1.0
    share = F.col("total") / F.lit(n)
    repeated = F.pow(share, F.lit(a - 1)) / F.pow(F.lit(high) / F.lit(n), F.lit(a - 1)) * F.lit(settings.epochs)
    has = F.col("total") > 0
    quota = F.when(has, F.floor(F.col("total") * F.round(repeated, 9))).otherwise(0).cast("bigint")
    planned = totals.withColumn("weight", F.when(has, F.round(F.pow(share, F.lit(a)) / F.lit(scale), 9)).otherwise(F.lit(0.0))).withColumn("quota", quota)
    full = F.when(has, F.floor(F.col("quota") / F.greatest("total", F.lit(1)))).otherwise(settings.epochs).cast("bigint")
    return planned.withColumn("full", full).withColumn("rest", F.when(has, F.col("quota") - F.col("full") * F.col("total")).otherwise(0))


def permutation_key(block, settings: Settings = Settings()):
    """Where a document stands in a block of its source: the md5 of seed, block and key."""
    return F.md5(F.concat_ws(":", F.lit(str(settings.seed)), block.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with the plan of their source, null being a source of its own. One row per source on the right."""
    small = plan.withColumnRenamed("source", "_source")
    if plan.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    return rows.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def plan(slim: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """What each source gives: weight, quota, full, rest and ``cut``, the last permutation key of its partial block.

    The partial block takes documents in the order of their keys while tokens of the rest are left, whole
    documents each. Tokens are first summed by source and bin of the key, so that only the documents of the
    one bin where a source's rest runs out are ever put in order.
    """
    totals = _totals(slim)
    planned = materialize(quotas(totals, exponent(totals, settings), settings))
    key = permutation_key(F.col("full") + 1, settings)
    partial = _joined(slim, planned.where("rest > 0").select("source", "full", "rest")).withColumn("key", key)
    partial = partial.withColumn("bin", F.left("key", F.lit(BIN_DIGITS)))
    by_bin = materialize(partial.groupBy("source", "bin", "rest").agg(F.sum("n_tokens").alias("n")))
    up_to = F.sum("n").over(Window.partitionBy("source").orderBy("bin"))
    edge = by_bin.withColumn("upto", up_to).where("upto - n < rest and rest <= upto")
    edge = materialize(edge.select(F.col("source").alias("_source"), F.col("bin").alias("_bin"), (F.col("rest") - F.col("upto") + F.col("n")).alias("left")))
    at_edge = partial.join(
        F.broadcast(edge) if edge.count() <= BROADCAST_SOURCES else edge,
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("bin") == F.col("_bin")),
    )
    keys = at_edge.groupBy("source", "key", "left").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = keys.withColumn("before", before).where("before < left").groupBy("source").agg(F.max("key").alias("cut"))
    cut = cut.withColumnRenamed("source", "_source")
    return materialize(planned.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"))


def mix(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``documents`` repeated as the mixture says, with ``block`` (from 1), ``order_key`` and ``weight``.

    Within a source, the rows of a block in the order of ``order_key`` are a random permutation of its
    documents; the last block may be partial. Null and empty texts have no tokens and take part in every
    block reached. Rows with one doc_id move together. A null source is a source of its own, and a source
    without any token is given ``epochs`` times. An empty table gives an empty result. Columns named block,
    order_key or weight are replaced.
    """
    own = [c for c in documents.columns if c not in ("block", "order_key", "weight", "_source", "full", "cut")]
    slim = materialize(documents.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens")))
    planned = plan(slim, settings).select("source", "weight", "full", "cut")
    rows = _joined(documents.select(*own), planned)
    more = F.when(permutation_key(F.col("full") + 1, settings) <= F.col("cut"), 1).otherwise(0)
    copies = rows.withColumn("block", F.explode(F.sequence(F.lit(1), (F.col("full") + more).cast("int"))))
    return copies.withColumn("order_key", permutation_key(F.col("block"), settings)).select(*own, "block", "order_key", "weight")


def mixed(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, source, block, order_key and weight of the mixture: one row each time a document is given."""
    return mix(documents.select("doc_id", "source", "text"), settings).select("doc_id", "source", "block", "order_key", "weight")


#: The same for DuckDB with the default settings: repetition 2, one epoch, 30 steps of bisection, seed 5.
SQL = r"""
WITH RECURSIVE slim AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS n_tokens FROM documents
), totals AS (
    SELECT source, sum(n_tokens)::BIGINT AS total FROM slim GROUP BY source
), ends AS (
    SELECT sum(total)::DOUBLE AS n, min(total)::DOUBLE AS low, max(total)::DOUBLE AS high, count(*) AS k FROM totals WHERE total > 0
), bisected(step, lo, hi) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT step + 1,
        CASE WHEN pow(low / high, (lo + hi) / 2 - 1) <= 2 THEN lo ELSE (lo + hi) / 2 END,
        CASE WHEN pow(low / high, (lo + hi) / 2 - 1) <= 2 THEN (lo + hi) / 2 ELSE hi END
    FROM bisected, ends WHERE step < 30
), a AS (
    SELECT CASE WHEN k < 2 THEN 1 WHEN pow(low / high, -1) <= 2 THEN 0 ELSE hi END AS a FROM bisected, ends WHERE step = 30
), scaled AS (
    SELECT sum(pow(total / n, a)) AS s FROM totals, ends, a WHERE total > 0
), quotas AS (
    SELECT source, total,
        CASE WHEN total > 0 THEN round(pow(total / n, a) / s, 9) ELSE 0.0 END AS weight,
        CASE WHEN total > 0 THEN floor(total * round(pow(total / n, a - 1) / pow(high / n, a - 1), 9)) ELSE 0 END::BIGINT AS quota
    FROM totals, ends, a, scaled
), planned AS (
    SELECT *, CASE WHEN total > 0 THEN quota // total ELSE 1 END AS whole, CASE WHEN total > 0 THEN quota % total ELSE 0 END AS rest FROM quotas
), keyed AS (
    SELECT s.*, whole, rest, weight, md5('5:' || (whole + 1) || ':' || coalesce(s.doc_id::VARCHAR, '')) AS key
    FROM slim s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
), summed AS (
    SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        - sum(n_tokens) OVER (PARTITION BY source, key) AS before
    FROM keyed
), given AS (
    SELECT doc_id, source, weight, unnest(generate_series(1, whole + CASE WHEN before < rest THEN 1 ELSE 0 END)) AS block FROM summed
)
SELECT doc_id, source, block::INT AS block, md5('5:' || block || ':' || coalesce(doc_id::VARCHAR, '')) AS order_key, weight FROM given
"""
