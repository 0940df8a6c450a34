"""k-mer features on long tables: one row per (repertoire, k, kmer), zeros left implicit."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagscope.functions.kmers import explode_kmers
from bagscope.functions.text import feature_name
from bagscope.operators.joins import lookup_join
from bagscope.operators.ranking import ordered_index
from bagscope.session import materialize

ID = "repertoire_id"


def kmer_counts(
    sequences: DataFrame, k_list: Iterable[int], sequence_col: str = "junction_aa", by: Sequence[str] = (ID,),
    vocab: DataFrame | None = None,
) -> DataFrame:
    """Occurrences of every k-mer per repertoire, with multiplicity within and across sequences.

    ``by`` may add the dataset, so that one job covers many. With a stored ``vocab`` only its k-mers are
    counted: the others are left out before anything is shuffled. Counts are combined on the map side, so what is
    shuffled is at most one row per task, repertoire and k-mer; the shuffle key spreads both a huge
    repertoire and a very common k-mer.
    """
    occurrences = explode_kmers(sequences, k_list, keep=list(by), sequence_col=sequence_col)
    if vocab is not None:
        occurrences = lookup_join(occurrences.select(*by, "k", "kmer"), vocab.select("kmer"), ["kmer"], "left_semi")
    return occurrences.groupBy(*by, "k", "kmer").agg(F.count(F.lit(1)).alias("cnt"))


def total_counts(sequences: DataFrame, k_list: Iterable[int], sequence_col: str = "junction_aa") -> DataFrame:
    """(k, kmer, cnt) over all repertoires, for when only the vocabulary is wanted.

    Each task sends one row per distinct k-mer, so the shuffle is as small as the vocabulary.
    """
    occurrences = explode_kmers(sequences, k_list, keep=[], sequence_col=sequence_col)
    return occurrences.groupBy("k", "kmer").agg(F.count(F.lit(1)).alias("cnt"))


def only_k(features: DataFrame, k: int) -> DataFrame:
    return features.where(F.col("k") == k)


def vocabulary(counts: DataFrame, min_count: int = 1) -> DataFrame:
    """k-mers whose total count over all repertoires reaches ``min_count``.

    Takes per-repertoire counts or :func:`total_counts`.
    """
    totals = counts.groupBy("k", "kmer").agg(F.sum("cnt").alias("total"))
    return totals.where(F.col("total") >= min_count)


def forced_k_list(k_list: Iterable[int], forced: Iterable[str]) -> list[int]:
    """Lengths to extract: forced k-mers bring their own lengths with them."""
    return sorted({*k_list, *(len(kmer) for kmer in forced)})


def vocabulary_with_forced(counts: DataFrame, min_count: int, forced: Iterable[str]) -> DataFrame:
    """As :func:`vocabulary`, but listed k-mers stay at any count if they were observed at all.

    ``counts`` must be built with :func:`forced_k_list`, so frequent k-mers of the forced lengths enter too.
    """
    totals = counts.groupBy("k", "kmer").agg(F.sum("cnt").alias("total"))
    wanted = F.col("kmer").isin(list(forced)) if forced else F.lit(False)
    return totals.where((F.col("total") >= min_count) | wanted)


def index_vocabulary(vocab: DataFrame) -> DataFrame:
    """Column number of each k-mer, in order of length, then text."""
    return ordered_index(vocab, [F.col("k"), F.col("kmer")], "idx")


def vocabulary_summary(counts: DataFrame, min_count: int) -> DataFrame:
    """One row: distinct k-mers, those kept and the share dropped."""
    totals = counts.groupBy("k", "kmer").agg(F.sum("cnt").alias("total"))
    return totals.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("total") >= min_count).alias("n_frequent"),
    ).select(
        "n_total",
        "n_frequent",
        ((F.lit(1.0) - F.col("n_frequent") / F.col("n_total")) * 100).alias("reduction_pct"),
    )


def align(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Restrict counts to the vocabulary: unseen k-mers drop out, absent ones stay implicit zeros."""
    return lookup_join(counts, vocab.select("kmer", *[c for c in ("idx",) if c in vocab.columns]), ["kmer"])


def zero_filled(ids: DataFrame, counts: DataFrame) -> DataFrame:
    """Exactly the listed repertoires: their k-mer rows, or one row with a null k-mer and count 0.

    Only distinct ids are shuffled to find the empty ones; the long rows are filtered where they are.
    """
    wanted = ids.select(ID).distinct()
    kept = lookup_join(counts, wanted, [ID], "left_semi")
    empty = wanted.join(counts.select(ID).distinct(), ID, "left_anti")
    filler = [
        F.col(c) if c == ID else F.lit(0).cast(t) if c == "cnt" else F.lit(None).cast(t)
        for c, t in ((f.name, f.dataType) for f in counts.schema.fields)
    ]
    return kept.unionByName(empty.select(*[f.alias(c) for f, c in zip(filler, counts.columns)]))


def frequencies(counts: DataFrame) -> DataFrame:
    """Count divided by the repertoire's total over the kept features (a zero total divides by one).

    The totals, one row per repertoire, are stored and join back without moving the long rows.
    """
    totals = materialize(counts.groupBy(ID).agg(F.sum("cnt").alias("row_total")))
    divisor = F.when(F.col("row_total") == 0, F.lit(1)).otherwise(F.col("row_total"))
    return lookup_join(counts, totals, [ID]).withColumn("freq", F.col("cnt") / divisor)


def feature_variance(values: DataFrame, n_repertoires: DataFrame, value_col: str = "freq") -> DataFrame:
    """Population variance of each feature over all repertoires, counting the implicit zeros.

    ``n_repertoires`` is a one-row, one-column table; absent rows are zeros, so N comes from there. The
    sum of squares is taken about the mean of the stored values to keep rare features accurate.
    """
    n = n_repertoires.scalar()
    stats = values.groupBy("k", "kmer").agg(
        F.count(value_col).alias("__m"), F.avg(value_col).alias("__mu"), F.var_pop(value_col).alias("__var")
    )
    m, mu, var = F.col("__m"), F.col("__mu"), F.col("__var")
    # pooled variance of m stored values and (n - m) zeros
    share = m / n
    return stats.select("k", "kmer", (share * var + share * (F.lit(1.0) - share) * mu * mu).alias("variance"))


def top_variance(variances: DataFrame, n: int) -> DataFrame:
    """The ``n`` features with the largest training variance (all, when there are fewer)."""
    return variances.orderBy(F.desc("variance"), F.asc("k"), F.asc("kmer")).limit(n)


def feature_drift(sequences: DataFrame, train: str, k_list: Iterable[int], min_count: int = 1) -> DataFrame:
    """Features on one side only: ``missing`` in the test data or ``extra`` to the training vocabulary.

    ``train`` names a boolean column of the sequences. Both sides are counted in one pass: a feature is of the
    training vocabulary if training sequences hold it ``min_count`` times.
    """
    found = explode_kmers(sequences, k_list, keep=[train]).groupBy("k", "kmer").agg(
        F.count_if(F.col(train)).alias("__train"), F.count_if(~F.col(train)).alias("__test")
    )
    known = F.col("__train") >= min_count
    drift = F.when(known & (F.col("__test") == 0), "missing").when(~known & (F.col("__test") > 0), "extra")
    return found.select("k", "kmer", drift.alias("drift")).where("drift is not null")


def combine_blocks(blocks: dict[str, DataFrame]) -> DataFrame:
    """Stack feature blocks of the same repertoires as long rows tagged with their block."""
    tagged = [df.select(ID, F.lit(block).alias("block"), "kmer", "cnt") for block, df in blocks.items()]
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more)
    return out


def with_feature_name(features: DataFrame) -> DataFrame:
    return features.withColumn("feature", feature_name(F.col("k"), F.col("kmer")))


def population_scales(values: DataFrame, n: int, value: str = "value") -> DataFrame:
    """(idx, mean, scale): mean and population deviation of every feature over ``n`` repertoires, implicit zeros included.

    ``values`` holds (repertoire_id, idx, value) with each pair once. One combined aggregate by feature; nothing as wide
    as the vocabulary is gathered anywhere. The scale of a constant feature is 1.
    """
    sums = values.groupBy("idx").agg(F.sum(value).alias("__s"), F.sum(F.col(value) * F.col(value)).alias("__q"))
    mean = F.col("__s") / F.lit(n)
    variance = F.col("__q") / F.lit(n) - mean * mean
    scale = F.when(variance > F.lit(1e-12) * F.greatest(mean * mean, F.lit(1.0)), F.sqrt(variance)).otherwise(F.lit(1.0))
    return sums.select("idx", mean.alias("mean"), scale.alias("scale"))
