"""k-mer extraction as generator expressions that keep whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def start_positions(sequence: Column, k: Column | int) -> Column:
    """``[1, .., length - k + 1]``, or null when the sequence is null or shorter than ``k``."""
    last = F.length(sequence) - (F.lit(k) if isinstance(k, int) else k) + F.lit(1)
    return F.when(last >= 1, F.sequence(F.lit(1), last))


def explode_kmers(
    sequences: DataFrame,
    k_list: Iterable[int],
    keep: Sequence[str],
    sequence_col: str = "junction_aa",
    keep_empty: bool = False,
) -> DataFrame:
    """One row per k-mer occurrence: ``keep`` columns, ``k``, ``pos`` (1-based) and ``kmer``.

    With ``keep_empty`` a sequence without any k-mer stays as a row with a null ``kmer``.
    """
    ks = sorted(set(k_list))
    generate = F.explode_outer if keep_empty else F.explode
    carried = list(dict.fromkeys([*keep, sequence_col]))
    if len(ks) == 1:
        with_k = sequences.select(*carried, F.lit(ks[0]).alias("k"))
    else:
        with_k = sequences.select(*carried, F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    source = F.col(sequence_col)
    placed = with_k.select(*carried, "k", generate(start_positions(source, F.col("k"))).alias("pos"))
    kmer = F.substring(source, F.col("pos"), F.col("k")).alias("kmer")
    return placed.select(*carried, "k", "pos", kmer)


def first_occurrence(sequence: Column, kmer: Column, pos: Column) -> Column:
    """True where ``pos`` is the first place of ``kmer`` in ``sequence``: a distinct filter without a set."""
    return F.position(kmer, sequence) == pos
