"""Every registered query: the operators applied to whole benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagscope.functions import text as tx
from bagscope.models import encoder, zoo
from bagscope.models import training as tr
from bagscope.models import vectors as vc
from bagscope.models.clone_model import fit_clone_model
from bagscope.operators import clones as cl
from bagscope.operators import datasets as ds
from bagscope.operators import ensemble as en
from bagscope.operators import folds as fo
from bagscope.operators import importance as im
from bagscope.operators import kmers as km
from bagscope.operators import metrics as me
from bagscope.operators import pooling as po
from bagscope.operators import ranking as rk
from bagscope.plans import pipeline as pl
from bagscope.plans import tables
from bagscope.plans.config import CONFIGS, STANDARD
from bagscope.session import materialize, shared_folder
from bagscope.sources import repertoires as rp
from bagscope.sources import store as sk

CLONE = tx.CLONE_COLUMNS

FORCED = ["tionn", "ander", "ouer", "ereau", "zzzzz"]
MIN_COUNT = 20
TOP_VARIANCE = 5000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


# --- k-mers -------------------------------------------------------------------------------------


@query
def kmer_counts_k3(spark, sf_dir):
    return km.kmer_counts(tables.sequences(spark, sf_dir), [3]).select("repertoire_id", "kmer", "cnt")


@query
def kmer_counts_k34(spark, sf_dir):
    return km.kmer_counts(tables.sequences(spark, sf_dir), [3, 4])


@query
def kmer_only_k4(spark, sf_dir):
    """Keep one block of a feature table by its k."""
    return km.only_k(km.kmer_counts(tables.sequences(spark, sf_dir), [3, 4]), 4)


@query
def kmer_vocab_min20(spark, sf_dir):
    return km.vocabulary(km.total_counts(tables.sequences(spark, sf_dir), [3, 4]), MIN_COUNT)


@query
def top_kmers(spark, sf_dir):
    """Flagship: the 20 most frequent k-mers that survive vocabulary pruning."""
    vocab = km.vocabulary(km.total_counts(tables.sequences(spark, sf_dir), [3, 4]), MIN_COUNT)
    return vocab.orderBy(F.desc("total"), F.asc("k"), F.asc("kmer")).limit(20)


@query
def kmer_vocab_forced(spark, sf_dir):
    ks = km.forced_k_list([3, 4], FORCED)
    return km.vocabulary_with_forced(km.total_counts(tables.sequences(spark, sf_dir), ks), MIN_COUNT, FORCED)


@query
def kmer_vocab_index(spark, sf_dir):
    vocab = km.vocabulary(km.total_counts(tables.sequences(spark, sf_dir), [3, 4]), MIN_COUNT)
    return km.index_vocabulary(vocab)


@query
def kmer_vocab_summary(spark, sf_dir):
    counts = km.total_counts(tables.sequences(spark, sf_dir), [3, 4])
    return km.vocabulary_summary(counts, MIN_COUNT).select("n_total", "n_frequent", _r("reduction_pct"))


@query
def kmer_feature_names(spark, sf_dir):
    """Display names of the pruned vocabulary, and k and k-mer parsed back from them."""
    vocab = km.vocabulary(km.total_counts(tables.sequences(spark, sf_dir), [3, 4]), MIN_COUNT)
    name = F.col("feature")
    return km.with_feature_name(vocab).select(
        "feature", tx.feature_k(name).alias("parsed_k"), tx.feature_kmer(name).alias("parsed_kmer")
    )


def _train_counts(spark, sf_dir, k_list):
    """Stored k-mer counts of the labelled documents."""
    return materialize(km.kmer_counts(tables.sequences(spark, sf_dir, "train"), k_list))


@query
def kmer_align_test(spark, sf_dir):
    """Test counts restricted to the pruned training vocabulary."""
    vocab = materialize(km.vocabulary(km.total_counts(tables.sequences(spark, sf_dir, "train"), [3, 4]), MIN_COUNT))
    return km.kmer_counts(tables.sequences(spark, sf_dir, "test"), [3, 4], vocab=vocab).select("kmer", "repertoire_id", "k", "cnt")


@query
def kmer_zero_filled(spark, sf_dir):
    """Every document by id, with a zero row where it has no k-mer of length 12."""
    counts = materialize(km.kmer_counts(tables.sequences(spark, sf_dir), [12]))
    ids = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("repertoire_id"))
    return km.zero_filled(ids, counts).select("repertoire_id", "kmer", "cnt")


@query
def kmer_feature_drift(spark, sf_dir):
    return km.feature_drift(tables.flagged_sequences(spark, sf_dir), "train", [3, 4], MIN_COUNT)


@query
def kmer_freq_norm(spark, sf_dir):
    """Row frequencies over the pruned 4-mer vocabulary of the training set."""
    train = _train_counts(spark, sf_dir, [4])
    kept = km.align(train, materialize(km.vocabulary(train, 2)))
    return km.frequencies(kept).select("repertoire_id", "kmer", _r("freq", 9))


@query
def kmer_top_variance(spark, sf_dir):
    """The 5,000 4-mers whose training frequency varies most, absent k-mers counting as zeros."""
    train = _train_counts(spark, sf_dir, [4])
    kept = km.align(train, materialize(km.vocabulary(train, 2)))
    n = tables.labels(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    variances = km.feature_variance(km.frequencies(kept), n)
    rounded = variances.withColumn("variance", F.round("variance", 12))
    return km.top_variance(rounded, TOP_VARIANCE).select("kmer", "variance")


@query
def kmer_blocks(spark, sf_dir):
    """3-mer and 4-mer blocks stacked on the repertoire id, summarised per block."""
    sequences = tables.sequences(spark, sf_dir)
    blocks = {f"k{k}": km.kmer_counts(sequences, [k]) for k in (3, 4)}
    stacked = km.combine_blocks(blocks)
    return stacked.groupBy("repertoire_id", "block").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("cnt").alias("n_kmers")
    )


# --- clones -------------------------------------------------------------------------------------


def _clone_counts(spark, sf_dir):
    presence = cl.clone_presence(tables.sequences(spark, sf_dir, "train"))
    return cl.clone_counts(presence, tables.labels(spark, sf_dir))


def _clone_stats(spark, sf_dir, gate=cl.Gate()):
    return cl.clone_stats(_clone_counts(spark, sf_dir), tables.labels(spark, sf_dir), gate)


RELAXED = cl.Gate(min_pos=3, max_neg=None, p_cut=0.05)


@query
def clone_presence(spark, sf_dir):
    return cl.clone_presence(tables.sequences(spark, sf_dir))


@query
def clone_distinct(spark, sf_dir):
    return cl.distinct_clones(tables.sequences(spark, sf_dir))


@query
def clone_counts(spark, sf_dir):
    """Positive and negative documents per clone, for clones of positive documents."""
    return _clone_counts(spark, sf_dir)


@query
def clone_fisher(spark, sf_dir):
    """Exact p-values of every clone in three or more positive documents."""
    return _clone_stats(spark, sf_dir, RELAXED).where("p_value is not null").select(*CLONE, "pos", "neg", _r("p_value", 9))


@query
def clone_selected(spark, sf_dir):
    """Clones through the strict gate, indexed in clone order."""
    kept = cl.index_clones(cl.kept_clones(_clone_stats(spark, sf_dir)))
    return kept.select(*CLONE, "pos", "neg", _r("p_value", 9), "idx")


@query
def clone_selected_customers(spark, sf_dir):
    """Part kinds enriched among customers of one market segment, negatives allowed."""
    labels = tables.customer_labels(spark, sf_dir)
    counts = cl.clone_counts(cl.clone_presence(tables.customer_parts(spark, sf_dir)), labels)
    return cl.kept_clones(cl.clone_stats(counts, labels, RELAXED)).select(*CLONE, "pos", "neg", _r("p_value", 9))


@query
def clone_funnel(spark, sf_dir):
    return cl.funnel(_clone_stats(spark, sf_dir))


@query
def clone_strongest(spark, sf_dir):
    """The five clones with the smallest p-values."""
    stats = _clone_stats(spark, sf_dir, RELAXED).withColumn("p_value", F.round("p_value", 9))
    return cl.strongest(stats, 5)


@query
def clone_matrix(spark, sf_dir):
    """Which selected clones each document holds, train and test alike; statistics take the labelled ones alone."""
    labels = tables.labels(spark, sf_dir)
    presence = cl.clone_presence(tables.sequences(spark, sf_dir, "train"))
    stats = cl.clone_stats(cl.clone_counts(presence, labels), labels)
    chosen = materialize(cl.index_clones(cl.kept_clones(stats)))
    return cl.clone_matrix(tables.sequences(spark, sf_dir), chosen)


@query
def clone_first_100(spark, sf_dir):
    """The first 100 selected clones in clone order."""
    return cl.first_clones(cl.index_clones(cl.kept_clones(_clone_stats(spark, sf_dir))), 100).select(*CLONE, "idx")


@query
def clone_freq_positive(spark, sf_dir):
    """Copies of each clone in positive documents."""
    return cl.clone_frequency(tables.sequences(spark, sf_dir), tables.labels(spark, sf_dir))


@query
def clone_set_freq_positive(spark, sf_dir):
    """Positive documents that hold each clone."""
    presence = cl.clone_presence(tables.sequences(spark, sf_dir))
    return cl.clone_frequency(presence, tables.labels(spark, sf_dir))


# --- vectors ------------------------------------------------------------------------------------


def _pooled(name):
    def run(spark, sf_dir):
        pooled = po.pool_bags(tables.vectors(spark, sf_dir), [name])
        return po.long_vector(pooled, name).select("repertoire_id", "dim", _r("value"))

    run.__name__ = f"pool_{name}"
    run.__doc__ = f"Element-wise {name} of each bag of embeddings."
    return run


for _name in po.POOLINGS:
    query(_pooled(_name))


def _token_pooled(name):
    def run(spark, sf_dir):
        """Each embedding read as eight token vectors, the outer two special."""
        vectors = tables.vectors(spark, sf_dir)
        step = F.sequence(F.lit(0), F.lit(7))
        rows = vectors.select(
            "seq_no",
            F.transform(step, lambda i: F.slice("vector", i * 8 + 1, F.lit(8))).alias("tokens"),
            F.transform(step, lambda i: (i == 0) | (i == 7)).alias("special"),
        )
        pooled = po.pool_tokens(rows)
        return po.long_vector(pooled, name, by=["seq_no"]).select("seq_no", "dim", _r("value"))

    run.__name__ = f"pool_tokens_{name}"
    return run


for _name in ("cls", "mean", "max"):
    query(_token_pooled(_name))


# --- datasets, metadata, folds ------------------------------------------------------------------


def _document_ids(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("dataset"), F.col("doc_id").alias("repertoire_id")
    )


@query
def dataset_type_cv(spark, sf_dir):
    """Size variation of the documents of each language."""
    sequences = tables.sequences(spark, sf_dir).withColumnRenamed("v_call", "dataset")
    return ds.dataset_type(sequences).select(
        "dataset", "n_repertoires", _r("mean_seq"), _r("std_seq"), _r("cv"), "dataset_type"
    )


@query
def dataset_pairs(spark, sf_dir):
    """Languages as train datasets, language and source as their test datasets."""
    documents = tables.table(spark, sf_dir, "documents")
    train = documents.select(F.concat(F.lit("train_dataset_"), F.col("lang")).alias("dataset"))
    test = documents.select(F.concat(F.lit("test_dataset_"), F.col("lang"), F.lit("_"), F.col("source")).alias("dataset"))
    return ds.dataset_pairs(train, test).select("dataset", F.array_join("tests", ",").alias("tests"))


@query
def fingerprint_shares(spark, sf_dir):
    shares = ds.fingerprint_shares(tables.labels(spark, sf_dir), _document_ids(spark, sf_dir))
    return shares.select("dataset", "matched", _r("share"))


@query
def fingerprint_match(spark, sf_dir):
    """The first language holding most of the labelled documents."""
    return ds.fingerprint_match(tables.labels(spark, sf_dir), _document_ids(spark, sf_dir))


@query
def label_column_discovery(spark, sf_dir):
    return ds.label_columns(tables.table(spark, sf_dir, "labels"), ["doc_id", "quality", "toxic"])


@query
def validate_metadata(spark, sf_dir):
    """Label rows without a document and documents without a label row."""
    return rp.metadata_gaps(tables.labels(spark, sf_dir), _document_ids(spark, sf_dir))


@query
def stratified_folds(spark, sf_dir):
    return fo.stratified_folds(tables.labels(spark, sf_dir))


@query
def holdout_split(spark, sf_dir):
    return fo.holdout_split(tables.labels(spark, sf_dir))


@query
def class_weights(spark, sf_dir):
    return fo.class_weights(tables.labels(spark, sf_dir)).select("label", "n", _r("weight"))


@query
def sample_by_label(spark, sf_dir):
    return fo.sample_by_label(tables.labels(spark, sf_dir), 0.1)


@query
def sample_ids(spark, sf_dir):
    return fo.sample_ids(_document_ids(spark, sf_dir), 50)


@query
def sample_sequences(spark, sf_dir):
    """Ten random vectors of every bag."""
    return fo.sample_sequences(tables.vectors(spark, sf_dir).select("repertoire_id", "seq_no"), 10)


# --- scores and metrics -------------------------------------------------------------------------


def _scores(spark, sf_dir):
    """Three simple scores of every labelled document, one row per (document, model)."""
    documents = tables.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("repertoire_id"), "lang", (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("size"),
        F.size(F.split("text", " ")).alias("words"), F.size(F.split("text", "\n")).alias("lines"), "n_chars",
    )
    def score(model, order, value):
        return F.struct(F.lit(model).alias("model"), F.lit(order).alias("model_order"), F.round(value, 6).alias("score"))

    scores = F.array(
        score("size", 0, F.col("size")),
        score("words", 1, F.col("words") * 4 / F.greatest("n_chars", F.lit(1))),
        score("lines", 2, F.lit(1.0) / F.col("lines")),
    )
    labelled = documents.join(tables.labels(spark, sf_dir), "repertoire_id")
    return labelled.select("repertoire_id", "lang", "label", F.inline(scores))


@query
def roc_auc(spark, sf_dir):
    return me.roc_auc(_scores(spark, sf_dir), by=["model"]).select("model", _r("auc"))


@query
def roc_auc_by_language(spark, sf_dir):
    """AUC per language, for the languages that have both classes."""
    aucs = me.roc_auc(_scores(spark, sf_dir), by=["lang", "model"]).where("auc is not null")
    return aucs.select("lang", "model", _r("auc"))


@query
def classification_report(spark, sf_dir):
    report = me.classification_report(_scores(spark, sf_dir), by=["model"])
    return report.select("model", "n", *[_r(c) for c in report.columns[2:]])


@query
def hard_predictions(spark, sf_dir):
    return me.hard_predictions(_scores(spark, sf_dir)).select("repertoire_id", "model", "prediction")


def _fold_aucs(spark, sf_dir):
    folds = fo.stratified_folds(tables.labels(spark, sf_dir)).select("repertoire_id", "fold")
    scored = _scores(spark, sf_dir).join(folds, "repertoire_id")
    return me.roc_auc(scored, by=["model", "model_order", "fold"])


@query
def fold_summary(spark, sf_dir):
    summary = me.fold_summary(_fold_aucs(spark, sf_dir), by=["model"])
    return summary.select("model", _r("mean_auc"), _r("std_auc"))


@query
def grid_winner(spark, sf_dir):
    summary = me.fold_summary(_fold_aucs(spark, sf_dir), by=["model", "model_order"])
    return me.grid_winner(summary, order="model_order").select("model", _r("mean_auc"))


def _predictions(spark, sf_dir, model, dataset="train"):
    one = _scores(spark, sf_dir).where(F.col("model") == model)
    return im.as_prediction_rows(one, dataset)


@query
def compare_predictions(spark, sf_dir):
    compared = me.compare_predictions(_predictions(spark, sf_dir, "size"), _predictions(spark, sf_dir, "words"))
    return me.agreement(compared).select("n", _r("correlation"), _r("max_gap"), _r("mean_gap"))


def _model_weights(spark, sf_dir):
    """Weight of a score: how far its AUC is from one half."""
    aucs = me.roc_auc(_scores(spark, sf_dir), by=["model", "model_order"])
    return aucs.select("model", "model_order", (F.col("auc") - 0.5).alias("weight"), "auc")


def _selected(dataset_type, method="hybrid"):
    def run(spark, sf_dir):
        weights = materialize(_model_weights(spark, sf_dir))
        chosen = en.select_weights(weights, dataset_type, method)
        return chosen.select("model", _r("weight"), _r("auc"), _r("norm_weight"), _r("final_weight"))

    run.__name__ = f"ensemble_{dataset_type}" + (f"_{method}" if dataset_type == "synthetic" else "")
    return run


for _method in ("weights", "cv", "hybrid"):
    query(_selected("synthetic", _method))
query(_selected("experimental"))


@query
def blend(spark, sf_dir):
    """Fixed 0.8 / 0.2 blend of two scores."""
    wide = _scores(spark, sf_dir).groupBy("repertoire_id").pivot("model", ["size", "words"]).agg(F.max("score"))
    return en.blend(wide, {"size": 0.8, "words": 0.2}).select("repertoire_id", _r("score"))


# --- sequence importance and results ------------------------------------------------------------


def _coefficients(spark, sf_dir):
    """A coefficient for every pruned k-mer, by rule from its total count; a third of them zero."""
    vocab = km.vocabulary(km.total_counts(tables.sequences(spark, sf_dir), [3, 4]), MIN_COUNT)
    coef = (F.col("total") % 3 - 1).cast("double") * (F.col("total") % 5 + 1) / 8
    scale = (F.col("total") % 2 + 1).cast("double")
    return materialize(vocab.select("k", "kmer", coef.alias("coef"), scale.alias("scale")))


def _scored(spark, sf_dir, distinct_kmers):
    coefficients = _coefficients(spark, sf_dir)
    weights = im.ensemble_weights_table(coefficients) if distinct_kmers else im.baseline_weights_table(coefficients)
    return im.score_sequences(tables.sequences(spark, sf_dir), weights, [3, 4], distinct_kmers)


@query
def importance_distinct(spark, sf_dir):
    """Ensemble score: each distinct k-mer of a sequence once, signed and unscaled."""
    return _scored(spark, sf_dir, True).select(*CLONE, _r("importance_score"))


@query
def importance_baseline(spark, sf_dir):
    """Baseline score: absolute coefficients over all k-mer occurrences."""
    return _scored(spark, sf_dir, False).select(*CLONE, _r("importance_score"))


@query
def feature_importance(spark, sf_dir):
    return im.feature_importance(_coefficients(spark, sf_dir)).select("kmer", "coef", "importance_score")


@query
def active_features(spark, sf_dir):
    return im.active_features(_coefficients(spark, sf_dir))


@query
def top_sequences(spark, sf_dir):
    """The 1,000 best sequences in the result layout."""
    return im.fill_sentinels(im.top_sequences(_scored(spark, sf_dir, True), "train_dataset_1", 1000))


@query
def most_shared_clones(spark, sf_dir):
    """The 500 clones held by the most positive documents: the answer when no clone is enriched."""
    ranked = pl.most_shared_clones(tables.sequences(spark, sf_dir), tables.labels(spark, sf_dir), 500)
    return ranked.select(*CLONE, F.col("n").cast("long").alias("n"), "rank")


@query
def requested_vectors(spark, sf_dir):
    """Embeddings asked for by a list that also names vectors that do not exist."""
    vectors = tables.vectors(spark, sf_dir).select(
        F.col("repertoire_id").cast("string").alias("dataset"), F.col("seq_no").alias("repertoire_id")
    )
    requests = tables.table(spark, sf_dir, "labels").select(
        (F.col("doc_id") % 10).cast("string").alias("dataset"), F.col("doc_id").alias("ID")
    )
    return ds.requested_vectors(requests, vectors)


@query
def union_submission(spark, sf_dir):
    """Predictions and important sequences as one result table in file form."""
    predictions = [_predictions(spark, sf_dir, m, f"test_dataset_{m}") for m in ("size", "words")]
    kept = cl.index_clones(cl.kept_clones(_clone_stats(spark, sf_dir)))
    sequences = im.as_result_rows(kept.withColumn("rank", F.col("idx") + 1), "train_dataset_1")
    combined = im.union_results(predictions, [sequences])
    return im.fill_sentinels(combined)


# --- scalar functions ---------------------------------------------------------------------------


@query
def encoder_ids(spark, sf_dir):
    """Short encoder ids from names made of the document columns."""
    name = F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("hub/esm2_t"), F.col("doc_id").cast("string"), F.lit("_8M_"), F.col("lang"))
    ).otherwise(F.col("source"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", tx.model_id(name).alias("model_id"))


@query
def encoder_inputs(spark, sf_dir):
    """Distinct sequences as an encoder sees them, cut to its token limit."""
    cut = tx.truncate_for_encoder(F.col("junction_aa"))
    return tables.sequences(spark, sf_dir).select(cut.alias("input")).distinct()


@query
def null_tokens(spark, sf_dir):
    """Sequences per language, and those whose text reads as null."""
    read = tx.null_tokens_to_null(F.col("junction_aa"))
    return tables.sequences(spark, sf_dir).groupBy("v_call").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(read.isNull()).alias("n_null")
    )


# --- sources and sinks: the tables written as files and read back ------------------------------


def _scratch(spark, name):
    return f"{shared_folder(spark)}/bagscope-{name}-{uuid.uuid4().hex}"


@query
def tsv_roundtrip(spark, sf_dir):
    """Parts bought per nation as repertoire files in two column orders, read back and counted."""
    customers = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repertoire_id"), "c_nationkey")
    rows = tables.customer_parts(spark, sf_dir).join(customers, "repertoire_id")
    rows = rows.withColumn("v_call", F.when(F.length("v_call") % 5 != 0, F.col("v_call")))
    root = _scratch(spark, "tsv")
    for parity, columns in enumerate(([*CLONE], ["v_call", "extra", "j_call", "junction_aa"])):
        part = rows.where(F.col("c_nationkey") % 2 == parity).withColumn("extra", F.lit("x"))
        sk.save_tsv(part.select(*columns), f"{root}/train_dataset_{parity}")
    read = rp.read_sequences(spark, [f"{root}/train_dataset_{i}" for i in (0, 1)], pattern="*.csv")
    return read.groupBy("dataset", *CLONE).agg(F.count(F.lit(1)).alias("n"))


def _customer_metadata(spark, sf_dir):
    """Metadata of customers, written as a CSV file and read back: the file name is the key where no id is given."""
    customers = tables.table(spark, sf_dir, "customer")
    path = _scratch(spark, "metadata")
    customers.select(
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("repertoire_id"),
        F.concat(F.col("c_custkey").cast("string"), F.lit(".tsv")).alias("filename"),
        F.initcap((F.col("c_mktsegment") == "BUILDING").cast("string")).alias("label_positive"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise("unknown").alias("age"),
    ).write.csv(path, header=True)
    return rp.read_metadata(spark, path, labelled=True)


@query
def metadata_labels(spark, sf_dir):
    """Keys, labels and ages of a metadata file; -1 for an age that can't be read."""
    age = F.coalesce("age", F.lit(-1)).alias("age")
    return _customer_metadata(spark, sf_dir).select("repertoire_id", "label_positive", "label", age)


@query
def full_dataset(spark, sf_dir):
    """All clones bought with the id and the label of their customer, counted; customers without orders drop out."""
    sequences = tables.customer_parts(spark, sf_dir).withColumn("repertoire_id", F.col("repertoire_id").cast("string"))
    full = rp.full_dataset(sequences, materialize(_customer_metadata(spark, sf_dir)))
    return full.groupBy("ID", "label_positive").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("v_call").alias("n_v_calls"))


@query
def labelled_features(spark, sf_dir):
    """3-mer counts of the labelled documents, each with its label."""
    counts = km.kmer_counts(tables.sequences(spark, sf_dir, "train"), [3])
    return rp.with_label(materialize(counts), tables.labels(spark, sf_dir)).select("repertoire_id", "kmer", "cnt", "label")


@query
def feature_store_roundtrip(spark, sf_dir):
    """3-mer counts kept per language: the second request computes only what the first left out."""
    store = sk.FeatureStore(spark, _scratch(spark, "store"))
    sequences = tables.sequences(spark, sf_dir)

    def build(datasets):
        held = sequences.where(F.col("v_call").isin(datasets))
        return km.kmer_counts(held.withColumn("dataset", F.col("v_call")), [3], by=("dataset", "repertoire_id"))

    store.ensure("kmers", ["de", "en"], build)
    kept = store.ensure("kmers", ["de", "en", "es", "fr"], build)
    return kept.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cnt").alias("n_kmers"))


@query
def embedding_store_roundtrip(spark, sf_dir):
    """Sequence vectors kept per dataset with two token poolings, read back and summed; one dataset has no rows."""
    store = sk.FeatureStore(spark, _scratch(spark, "store"))
    rows = tables.vectors(spark, sf_dir).select(
        F.concat(F.lit("part_"), (F.col("seq_no") % 3).cast("string")).alias("dataset"), "repertoire_id", "seq_no",
        F.col("vector").cast("array<float>").alias("mean"), F.transform("vector", lambda x: (-x).cast("float")).alias("max"),
    )
    kept = store.ensure("vectors", ["part_0", "part_1", "part_9"], lambda names: rows.where(F.col("dataset").isin(names)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return kept.groupBy("dataset", "repertoire_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(total("mean")), 4).alias("mean_sum"), F.round(F.sum(total("max")), 4).alias("max_sum")
    )


@query
def submission_roundtrip(spark, sf_dir):
    """Predictions and selected clones through the submission file."""
    predictions = [_predictions(spark, sf_dir, m, f"test_dataset_{m}") for m in ("size", "words")]
    kept = materialize(cl.index_clones(cl.kept_clones(_clone_stats(spark, sf_dir))))
    sequences = im.as_result_rows(kept.withColumn("rank", F.col("idx") + 1), "train_dataset_1")
    path = _scratch(spark, "submission")
    sk.save_submission(predictions, [sequences], path)
    schema = ", ".join(f"{c} {'double' if c == 'label_positive_probability' else 'string'}" for c in tx.RESULT_COLUMNS)
    return spark.read.options(header="true", quote='"', escape='"').schema(schema).csv(path)


@query
def repertoire_id_list(spark, sf_dir):
    """Ids that a metadata file lists."""
    return rp.repertoire_ids(spark, "", _customer_metadata(spark, sf_dir))


@query
def clone_artefact(spark, sf_dir):
    """Clone statistics written as a table and read back, with the reason why each clone was kept or dropped."""
    path = _scratch(spark, "clones")
    sk.save_clone_stats(_clone_stats(spark, sf_dir, RELAXED), path)
    return spark.read.parquet(path).select(*CLONE, "pos", "neg", _r("p_value", 9), "reason")


@query
def submission_order(spark, sf_dir):
    """The place of every row of a submission, counted through its files in the order of their names."""
    predictions = [_predictions(spark, sf_dir, m, f"test_dataset_{m}") for m in ("words", "size")]
    kept = cl.index_clones(cl.kept_clones(_clone_stats(spark, sf_dir)))
    sequences = im.as_result_rows(kept.withColumn("rank", F.col("idx") + 1), "train_dataset_1")
    path = _scratch(spark, "submission")
    sk.save_submission(predictions, [sequences], path)
    schema = ", ".join(f"{c} string" for c in tx.RESULT_COLUMNS)
    lines = spark.read.options(header="true", quote='"', escape='"').schema(schema).csv(path).select(
        "ID", "dataset", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    order = [F.col(c) for c in ("file", "block", "line")]
    return rk.ordered_index(materialize(lines), order, "place").select("ID", "dataset", "place")


@query
def labelled_vector_folds(spark, sf_dir):
    """Vectors with the label and the fold of their id, joined by key; ids without a label or a vector drop out."""
    vectors = tables.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("repertoire_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    labelled = rp.with_label(vectors, tables.labels(spark, sf_dir))
    folds = fo.stratified_folds(tables.labels(spark, sf_dir)).select("repertoire_id", "fold")
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return labelled.join(folds, "repertoire_id").select("repertoire_id", "label", "fold", F.round(total, 4).alias("total"))


# --- models (no SQL equivalent) -----------------------------------------------------------------


def _kmer_vectors(spark, sf_dir, config=STANDARD):
    """Stored fold vectors of the labelled documents and the features behind them."""
    counts = materialize(km.kmer_counts(tables.sequences(spark, sf_dir, "train"), config.k_list))
    folds = materialize(fo.stratified_folds(tables.labels(spark, sf_dir)))
    features = pl.fit_kmer_features(counts, folds, config)
    return features.vectors(counts, folds), features


@query
def clone_fold_selection(spark, sf_dir):
    """Clones kept for each fold's training set, with their counts there."""
    folds = materialize(fo.stratified_folds(tables.labels(spark, sf_dir)))
    presence = cl.clone_presence(tables.sequences(spark, sf_dir, "train"))
    kept = cl.kept_clones(cl.fold_clone_stats(cl.fold_clone_counts(presence, folds, 5), folds))
    return kept.select("fold", *CLONE, "pos", "neg", _r("p_value", 9))


@query
def kmer_scales(spark, sf_dir):
    """Mean and population deviation of every pruned k-mer over the labelled documents."""
    counts = materialize(km.kmer_counts(tables.sequences(spark, sf_dir, "train"), STANDARD.k_list))
    labels = tables.labels(spark, sf_dir)
    features = pl.fit_kmer_features(counts, labels, STANDARD)
    values = km.align(counts, features.vocab).select("repertoire_id", "idx", F.col("cnt").cast("double").alias("value"))
    scales = km.population_scales(values, labels.count())
    return scales.join(features.vocab, "idx").select("k", "kmer", _r("mean"), _r("scale"))


@query
def l1_kmer_model(spark, sf_dir):
    """Active coefficients of the scaled, balanced L1 model over the pruned k-mers."""
    vectors, features = _kmer_vectors(spark, sf_dir)
    fitted = pl.FittedPipeline(STANDARD, ["kmer"], {}, kmer=features, kmer_model=zoo.scaled_logistic(0.1).fit(vectors))
    return fitted.kmer_coefficients().where("coef <> 0").select("kmer", "coef", "scale")


@query
def baseline_classifier(spark, sf_dir):
    """Hold-out report of the L2 baseline over all k-mers."""
    vectors, _ = _kmer_vectors(spark, sf_dir)
    split = fo.holdout_split(tables.labels(spark, sf_dir))
    return tr.holdout_report(vectors.drop("fold"), split, zoo.scaled("LogReg_L2"))


@query
def kmer_c_grid(spark, sf_dir):
    """Mean AUC over five folds for every regularisation strength of the grid, all folds along one path."""
    counts = materialize(km.kmer_counts(tables.sequences(spark, sf_dir, "train"), STANDARD.k_list))
    folds = materialize(fo.stratified_folds(tables.labels(spark, sf_dir)))
    features = pl.fit_kmer_features(counts, folds, STANDARD)
    values = km.align(counts, features.vocab).select("repertoire_id", F.col("idx").cast("bigint").alias("idx"), F.col("cnt").cast("double").alias("value"))
    return tr.search_path(materialize(values), folds, STANDARD.c_grid)[1]


@query
def clone_model_scores(spark, sf_dir):
    """Clone-model scores of all documents, fitted on the labelled ones."""
    presence = materialize(cl.clone_presence(tables.sequences(spark, sf_dir, "train")))
    model = fit_clone_model(presence, tables.labels(spark, sf_dir))
    return model.score(tables.sequences(spark, sf_dir), _document_ids(spark, sf_dir).select("repertoire_id"))


@query
def clone_model_nothing_kept(spark, sf_dir):
    """No part kind passes the strict gate among customers, so everyone scores one half."""
    presence = materialize(cl.clone_presence(tables.customer_parts(spark, sf_dir)))
    labels = tables.customer_labels(spark, sf_dir)
    return fit_clone_model(presence, labels, cl.Gate(3, 0, 1e-6)).score(presence, labels.select("repertoire_id"))


@query
def clone_holdout(spark, sf_dir):
    """Hold-out report of the clone model."""
    presence = materialize(cl.clone_presence(tables.sequences(spark, sf_dir, "train")))
    return pl.evaluate_clone_model(presence, tables.labels(spark, sf_dir))


@query
def stacked_oof(spark, sf_dir):
    """Stacked k-mer and clone models: meta-learner weights, AUCs and the weights finally used."""
    config = replace(STANDARD, families=("kmer", "clone"))
    fitted = pl.fit(materialize(tables.sequences(spark, sf_dir)), tables.labels(spark, sf_dir), config)
    return fitted.report["weights"]


@query
def encoded_bags(spark, sf_dir):
    """Every document's tokens embedded (each distinct token once) and pooled."""
    vectors = encoder.embed_sequences(tables.sequences(spark, sf_dir), poolings=("max",))
    pooled = po.pool_bags(vectors, ["mean_std"], vector_col="max", copies="copies")
    return po.long_vector(pooled, "mean_std")


def _labelled_vectors(spark, sf_dir):
    """Single embeddings with a binary label and a fold, for the vector models."""
    rows = tables.vectors(spark, sf_dir).select(
        F.col("seq_no").alias("repertoire_id"), (F.col("repertoire_id") >= 5).cast("int").alias("label"), "vector"
    )
    vectors = vc.dense_vectors(rows, "vector")
    folds = fo.stratified_folds(rows.select("repertoire_id", "label"))
    return materialize(vectors.join(folds.select("repertoire_id", "fold"), "repertoire_id"))


@query
def classifier_zoo(spark, sf_dir):
    """Hold-out AUC of every classifier on the embeddings; the fits are independent and run side by side."""
    vectors = _labelled_vectors(spark, sf_dir)

    def scored(name):
        model = zoo.scaled(name).fit(vectors.where("fold <> 0"))
        return vc.score_with(model, vectors.where("fold = 0")).select(F.lit(name).alias("model"), "label", "score")

    names = [n for n in zoo.NAMES if n != "SVC_rbf"]  # the same machine as SVM_RBF
    with ThreadPool(len(names)) as pool:
        parts = pool.map(inheritable_thread_target(spark)(scored), names)
    return me.roc_auc(materialize(reduce(DataFrame.unionByName, parts)), by=["model"])


@query
def embedding_grid(spark, sf_dir):
    """Cross-validated AUC of the configured models on every pooling variant of the documents' embeddings."""
    labels = tables.labels(spark, sf_dir)
    folds = materialize(fo.stratified_folds(labels))
    poolings = pl.token_poolings(STANDARD.embedding_variants)
    embeddings = encoder.embed_sequences(tables.sequences(spark, sf_dir, "train"), poolings=poolings)
    variants = pl.embedding_variants(embeddings, STANDARD.embedding_variants)
    joined = {name: materialize(folds.join(vectors, "repertoire_id")) for name, vectors in variants.items()}
    return tr.search_embeddings(joined, STANDARD.embedding_models)


@query
def nested_search(spark, sf_dir):
    """Outer-fold AUC with the regularisation searched on inner folds."""
    vectors = _labelled_vectors(spark, sf_dir)
    inner = fo.stratified_folds(vectors.select("repertoire_id", "label"), 3, seed=7)
    nested = materialize(vectors.join(inner.select("repertoire_id", F.col("fold").alias("inner_fold")), "repertoire_id"))
    return tr.nested_search(nested)


@query
def blend_benchmark(spark, sf_dir):
    """AUC per fold of the kernel model, the k-mer model and their 0.8 / 0.2 blend."""
    config = CONFIGS["8"]
    sequences = tables.sequences(spark, sf_dir, "train")
    labels = materialize(tables.labels(spark, sf_dir))
    counts = materialize(km.kmer_counts(sequences, config.k_list))
    embeddings = encoder.embed_sequences(sequences, poolings=pl.token_poolings(("max_std",)))
    vectors = pl.embedding_variants(embeddings, ("max_std",))["max_std"]
    folds = materialize(fo.stratified_folds(labels))
    return pl.blend_benchmark(counts, materialize(vectors), folds, config)


@query
def pipeline_predictions(spark, sf_dir):
    """Predictions and important sequences of a k-mer pipeline, saved, loaded and put in result form."""
    config = CONFIGS["4"]
    sequences = materialize(tables.sequences(spark, sf_dir))
    labels = tables.labels(spark, sf_dir)
    path = _scratch(spark, "model")
    pl.fit(sequences, labels, config).save(path)
    fitted = pl.FittedPipeline.load(spark, path, config)
    test = _document_ids(spark, sf_dir).join(labels, "repertoire_id", "left_anti")
    predictions = fitted.predict(sequences, test)
    return im.fill_sentinels(im.union_results([predictions], [fitted.important_sequences(sequences, "train_dataset_4")]))


def _whole_pipeline(spark, sf_dir, name):
    """(ID, dataset, scored, clone columns): the result rows of a pipeline fitted on the labelled documents, predicting the others.

    ``scored`` says whether a row holds a probability; the probability itself is left out, for SQL can't fit models.
    """
    sequences = tables.sequences(spark, sf_dir)
    labels = materialize(tables.labels(spark, sf_dir))
    embeddings = encoder.embed_sequences(sequences, poolings=pl.token_poolings(CONFIGS[name].embedding_variants))  # stored in parts
    fitted = pl.fit(sequences, labels, CONFIGS[name], embeddings)
    test = _document_ids(spark, sf_dir).join(labels, "repertoire_id", "left_anti")
    predictions = fitted.predict(sequences, test, embeddings, f"test_dataset_{name}")
    important = fitted.important_sequences(sequences, f"train_dataset_{name}", labels=labels)
    rows = im.union_results([predictions], [important])
    scored = F.coalesce(F.col("label_positive_probability").between(0, 1), F.lit(False))
    return materialize(rows.select("ID", "dataset", scored.alias("scored"), *CLONE))


@query
def pipeline_blended(spark, sf_dir):
    """The pipeline of a kernel machine on embeddings blended with k-mer frequencies; the enriched clones are its answer."""
    return _whole_pipeline(spark, sf_dir, "8")
