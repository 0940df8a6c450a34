from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bagscope.operators import kmers as km
from tests.conftest import SEQUENCES


def brute_counts(ks):
    out = Counter()
    for rep, seq, *_ in SEQUENCES:
        for k in ks:
            for i in range(len(seq or "") - k + 1):
                out[rep, k, seq[i : i + k]] += 1
    return out


def as_dict(df):
    return {(r["repertoire_id"], r["k"], r["kmer"]): r["cnt"] for r in df.collect()}


def test_counts_match_brute_force(tiny):
    for ks in ([3], [3, 4], [2, 5, 6]):
        assert as_dict(km.kmer_counts(tiny, ks)) == brute_counts(ks)


def test_counts_keep_multiplicity(tiny):
    counts = as_dict(km.kmer_counts(tiny, [3]))
    assert counts["a", 3, "AAA"] == 3
    assert counts["a", 3, "CAS"] == 3
    assert not any(rep == "b" and kmer.startswith("CA") and len(kmer) == 2 for rep, _, kmer in counts)


def test_counts_do_not_depend_on_partitioning(tiny):
    assert as_dict(km.kmer_counts(tiny.repartition(7), [3, 4])) == as_dict(km.kmer_counts(tiny.coalesce(1), [3, 4]))


def test_non_ascii_text(spark):
    df = spark.createDataFrame([("x", "éàüßé😀é")], "repertoire_id string, junction_aa string")
    assert {r["kmer"] for r in km.kmer_counts(df, [3]).collect()} == {"éàü", "àüß", "üßé", "ßé😀", "é😀é"}


def test_vocabulary_and_forced(tiny):
    ks = km.forced_k_list([3], ["SLEET", "WWWWW"])
    assert ks == [3, 5]
    counts = km.kmer_counts(tiny, ks)
    plain = {r["kmer"] for r in km.vocabulary(counts, 3).collect()}
    forced = {r["kmer"] for r in km.vocabulary_with_forced(counts, 3, ["SLEET", "WWWWW"]).collect()}
    totals = Counter()
    for (_, _, kmer), n in brute_counts(ks).items():
        totals[kmer] += n
    assert plain == {k for k, n in totals.items() if n >= 3}
    assert forced == plain | {"SLEET"}


def test_vocabulary_index_is_sorted(tiny):
    rows = km.index_vocabulary(km.vocabulary(km.kmer_counts(tiny, [3, 4]))).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(len(rows)))
    assert [(r["k"], r["kmer"]) for r in rows] == sorted((r["k"], r["kmer"]) for r in rows)


def test_zero_filled_keeps_empty_repertoires(spark, tiny, tiny_labels):
    counts = km.kmer_counts(tiny, [3])
    filled = km.zero_filled(tiny_labels.select("repertoire_id"), counts)
    rows = filled.where("repertoire_id = 'e'").collect()
    assert [(r["kmer"], r["cnt"]) for r in rows] == [(None, 0)]
    assert filled.where("kmer is not null").count() == counts.count()


def test_align_drops_unseen(spark, tiny):
    vocab = spark.createDataFrame([("CAS", 0), ("ZZZ", 1)], "kmer string, idx long")
    rows = km.align(km.kmer_counts(tiny, [3]), vocab).collect()
    assert {r["kmer"] for r in rows} == {"CAS"}


def test_frequencies_and_variance_count_zeros(spark, tiny, tiny_labels):
    freqs = km.frequencies(km.kmer_counts(tiny, [3]))
    sums = freqs.groupBy("repertoire_id").agg(F.sum("freq").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)
    ids = [r[0] for r in tiny_labels.collect()]
    brute = brute_counts([3])
    kmers = sorted({key[2] for key in brute})
    x = np.array([[brute.get((i, 3, kmer), 0) for kmer in kmers] for i in ids], float)
    totals = x.sum(axis=1, keepdims=True)
    totals[totals == 0] = 1
    expected = dict(zip(kmers, np.var(x / totals, axis=0)))
    n = tiny_labels.agg(F.count(F.lit(1)).alias("n"))
    got = {r["kmer"]: r["variance"] for r in km.feature_variance(freqs, n).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)


def test_feature_drift(spark):
    rows = [("AAA", True), ("AAA", True), ("CCC", True), ("CCC", True), ("CCC", False), ("DDD", False), ("EEE", True), ("EEE", False), (None, True), ("FFF", True)]
    sequences = spark.createDataFrame(rows, "junction_aa string, train boolean")
    got = {tuple(r) for r in km.feature_drift(sequences, "train", [3], 2).collect()}
    assert got == {(3, "AAA", "missing"), (3, "DDD", "extra"), (3, "EEE", "extra")}


def test_counting_within_a_vocabulary_equals_aligning(spark, tiny):
    vocab = km.vocabulary(km.kmer_counts(tiny, [3, 4]), 2)
    inside = {tuple(r) for r in km.kmer_counts(tiny, [3, 4], vocab=vocab).select("repertoire_id", "kmer", "cnt").collect()}
    aligned = {tuple(r) for r in km.align(km.kmer_counts(tiny, [3, 4]), vocab).select("repertoire_id", "kmer", "cnt").collect()}
    assert inside == aligned and inside
