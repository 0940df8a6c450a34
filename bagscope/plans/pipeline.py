"""Fit, predict and explain: the whole analysis of one dataset, driven by a :class:`PipelineConfig`."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import partial, reduce

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagscope.functions.text import CLONE_COLUMNS
from bagscope.models import training as tr
from bagscope.models.clone_model import CloneModel, fit_clone_model, out_of_fold_clone_scores
from bagscope.models.vectors import dense_vectors, score_with, sparse_vectors
from bagscope.models.zoo import classifier, scaled, scaled_logistic
from bagscope.operators import clones as cl
from bagscope.operators import ensemble as en
from bagscope.operators import folds as fo
from bagscope.operators import importance as im
from bagscope.operators import kmers as km
from bagscope.operators.datasets import type_from_sizes
from bagscope.operators.joins import lookup_join
from bagscope.operators.pooling import pool_bags
from bagscope.operators.ranking import top_k
from bagscope.plans.config import PipelineConfig
from bagscope.session import materialize

ID = "repertoire_id"
BAG_POOLINGS = ["mean", "max", "std", "mean_std"]


@dataclass
class KmerFeatures:
    """A training vocabulary and how counts become model features."""

    vocab: DataFrame  # k, kmer, idx
    width: int
    frequencies: bool
    totals: DataFrame | None = None  # all kept k-mers, when ``vocab`` is a selection of them

    def vectors(self, counts: DataFrame, ids: DataFrame) -> DataFrame:
        if self.frequencies:
            values = km.frequencies(km.align(counts, self.totals.select("k", "kmer")))
            rows = km.align(values.select(ID, "kmer", F.col("freq").alias("value")), self.vocab)
        else:
            rows = km.align(counts, self.vocab).withColumn("value", F.col("cnt").cast("double"))
        return sparse_vectors(ids, rows.select(ID, "idx", "value"), self.width)


def fit_kmer_features(counts: DataFrame, labels: DataFrame, config: PipelineConfig) -> KmerFeatures:
    """Vocabulary of the labelled repertoires, pruned by count, forced k-mers and variance as configured."""
    train = lookup_join(counts, labels.select(ID), [ID], "left_semi")  # a fold's counts, or all
    kept = materialize(km.vocabulary_with_forced(train, config.min_count, config.forced))
    chosen = kept
    if config.top_variance is not None:
        n = labels.agg(F.count(F.lit(1)).alias("n"))
        variances = km.feature_variance(km.frequencies(km.align(train, kept.select("k", "kmer"))), n)
        chosen = km.top_variance(variances, config.top_variance)
    vocab = materialize(km.index_vocabulary(chosen.select("k", "kmer")))
    return KmerFeatures(vocab, vocab.count(), config.frequencies, kept if config.frequencies else None)


def most_shared_clones(sequences: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """The ``k`` clones held by the most positive repertoires, with their ``rank``."""
    positive = labels.where(F.col("label") == 1)
    held = lookup_join(sequences, positive.select(ID), [ID], "left_semi")
    shared = materialize(cl.clone_presence(held).groupBy(*CLONE_COLUMNS).agg(F.count(F.lit(1)).alias("n")))
    return top_k(shared.withColumn("n", F.col("n").cast("double")), "n", CLONE_COLUMNS, k)


def token_poolings(variants: tuple[str, ...] | None) -> tuple[str, ...]:
    """The token poolings behind the variants; None stands for all variants."""
    return tuple(p for p in ("max", "mean") if variants is None or any(v.startswith(f"{p}_") for v in variants))


def embedding_variants(embeddings: DataFrame, names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Repertoire vectors per ``<token pooling>_<bag pooling>``, each token pooling in one pass."""
    out = {}
    for token_pool in ("max", "mean"):
        wanted = [b for b in BAG_POOLINGS if names is None or f"{token_pool}_{b}" in names]
        if not wanted:
            continue
        copies = F.col("copies") if "copies" in embeddings.columns else F.lit(1).alias("copies")
        pooled = materialize(pool_bags(embeddings.select(ID, F.col(token_pool).alias("vector"), copies), wanted, copies="copies"))
        for bag_pool in wanted:
            out[f"{token_pool}_{bag_pool}"] = dense_vectors(pooled.select(ID, bag_pool), bag_pool)
    return out


@dataclass
class FittedPipeline:
    """Everything needed to score repertoires and rank sequences."""

    config: PipelineConfig
    models: list[str]
    weights: dict[str, float]
    kmer: KmerFeatures | None = None
    kmer_model: PipelineModel | None = None
    clone_model: CloneModel | None = None
    embedding_variant: str | None = None
    embedding_model: Model | None = None
    meta_model: Model | None = None
    report: dict[str, DataFrame] = field(default_factory=dict)

    def model_scores(self, sequences: DataFrame, ids: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
        """(ids.*, one column per model) for every listed repertoire."""
        out = ids
        if "kmer" in self.models:
            counts = km.kmer_counts(sequences, km.forced_k_list(self.config.k_list, self.config.forced))
            scored = score_with(self.kmer_model, self.kmer.vectors(materialize(counts), ids.select(ID)))
            out = out.join(scored.withColumnRenamed("score", "kmer"), ID, "left")
        if "clone" in self.models:
            presence = cl.clone_presence(sequences)
            out = out.join(self.clone_model.score(presence, ids.select(ID)).withColumnRenamed("score", "clone"), ID, "left")
        if "embedding" in self.models:
            own = lookup_join(embeddings, ids.select(ID).distinct(), [ID], "left_semi")
            vectors = embedding_variants(own, (self.embedding_variant,))[self.embedding_variant]
            scored = score_with(self.embedding_model, vectors).withColumnRenamed("score", "embedding")
            out = out.join(scored, ID, "left").withColumn("embedding", F.coalesce("embedding", F.lit(0.5)))
        return out

    def predict(
        self, sequences: DataFrame, ids: DataFrame, embeddings: DataFrame | None = None, dataset: str | None = None
    ) -> DataFrame:
        """Result rows of all test repertoires.

        Several test sets go in at once when ``ids`` and the inputs carry ``dataset``: repertoires are then
        told apart by dataset and id together.
        """
        several = "dataset" in ids.columns and "dataset" in sequences.columns
        if several:
            key = F.concat_ws("/", "dataset", F.col(ID).cast("string"))
            ids = ids.withColumn("__id", F.col(ID)).withColumn(ID, key)
            sequences = sequences.withColumn(ID, key)
            embeddings = None if embeddings is None else embeddings.withColumn(ID, key)
        scores = self.model_scores(sequences, ids, embeddings)
        if self.config.combine == "meta":
            scores = score_with(self.meta_model, tr.meta_vectors(scores, self.models))
        else:
            scores = en.blend(scores, self.weights)
        if several:
            scores = scores.withColumn(ID, F.col("__id"))
        return im.as_prediction_rows(scores, dataset)

    def kmer_coefficients(self) -> DataFrame:
        """(k, kmer, coef, scale) of the k-mer model, from its two stages."""
        scaler, logistic = self.kmer_model.stages
        assert isinstance(scaler, ElementwiseProduct)
        spark = self.kmer.vocab.sparkSession
        one = spark.createDataFrame([(logistic.coefficients, scaler.getScalingVec())], ["coef", "inverse"])
        pairs = F.arrays_zip(vector_to_array("coef").alias("coef"), vector_to_array("inverse").alias("inverse"))
        table = one.select(F.posexplode(pairs).alias("idx", "p")).select(
            "idx", "p.coef", (F.lit(1.0) / F.col("p.inverse")).alias("scale")
        )
        return materialize(lookup_join(self.kmer.vocab, table, ["idx"]))

    def important_sequences(
        self, sequences: DataFrame, dataset: str, limit: int | None = None, labels: DataFrame | None = None
    ) -> DataFrame:
        """The sequences behind the prediction, in the result layout.

        Where the clones themselves are the answer but none was kept, ``labels`` allows the clones held by
        most positive repertoires instead; without it the result is empty.
        """
        limit = limit or self.config.top_k
        if self.config.important == "clones":
            if self.clone_model.width == 0 and labels is not None:
                return im.as_result_rows(most_shared_clones(sequences, labels, limit), dataset)
            first = cl.first_clones(self.clone_model.selected, limit)
            return im.as_result_rows(first.withColumn("rank", F.col("idx") + 1), dataset)
        weights = materialize(im.ensemble_weights_table(self.kmer_coefficients()))
        ks = km.forced_k_list(self.config.k_list, self.config.forced)
        return im.top_sequences(im.score_sequences(sequences, weights, ks), dataset, limit)

    def save(self, path: str) -> None:
        spark = None
        if self.kmer is not None:
            spark = self.kmer.vocab.sparkSession
            self.kmer.vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
            if self.kmer.totals is not None:
                self.kmer.totals.write.mode("overwrite").parquet(f"{path}/kept")
            self.kmer_model.write().overwrite().save(f"{path}/kmer_model")
        if self.clone_model is not None:
            spark = self.clone_model.selected.sparkSession
            self.clone_model.save(f"{path}/clone_model")
        if self.embedding_model is not None:
            self.embedding_model.write().overwrite().save(f"{path}/embedding_model")
        if self.meta_model is not None:
            self.meta_model.write().overwrite().save(f"{path}/meta_model")
        spark = spark or SparkSession.getActiveSession()
        state = dict(models=self.models, weights=self.weights, variant=self.embedding_variant, config=asdict(self.config))
        spark.createDataFrame([(json.dumps(state),)], "state string").write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: PipelineConfig | None = None) -> FittedPipeline:
        """A saved pipeline with the configuration it was fitted with, unless another is given."""
        state = json.loads(spark.read.text(f"{path}/state").first()["value"])
        config = config or PipelineConfig.of(state["config"])
        out = cls(config, state["models"], state["weights"], embedding_variant=state["variant"])
        if "kmer" in out.models or config.important == "weights":
            vocab = spark.read.parquet(f"{path}/vocabulary")
            totals = spark.read.parquet(f"{path}/kept") if config.frequencies else None
            out.kmer = KmerFeatures(vocab, vocab.count(), config.frequencies, totals)
            out.kmer_model = PipelineModel.load(f"{path}/kmer_model")
        if "clone" in out.models or config.important == "clones":
            out.clone_model = CloneModel.load(spark, f"{path}/clone_model")
        if "embedding" in out.models:
            out.embedding_model = PipelineModel.load(f"{path}/embedding_model")
        if config.combine == "meta":
            out.meta_model = LogisticRegressionModel.load(f"{path}/meta_model")
        return out


def fit(
    sequences: DataFrame,
    labels: DataFrame,
    config: PipelineConfig,
    embeddings: DataFrame | None = None,
    overrides: dict | None = None,
) -> FittedPipeline:
    """Fit the configured pipeline on the labelled repertoires.

    ``labels`` is (repertoire_id, label); ``embeddings`` (repertoire_id, .., mean, max) per sequence.
    ``overrides`` replaces settings of named classifiers, for example to shrink forests in trial runs.
    Without embeddings the embedding family is left out.
    """
    settings_of = config.settings_of(overrides)
    families = [f for f in config.families if f != "embedding" or embeddings is not None]
    folds = materialize(fo.stratified_folds(labels, config.n_folds, config.seed))
    sequences = lookup_join(sequences, labels.select(ID), [ID], "left_semi")  # before anything is counted
    out = FittedPipeline(config, families, {})
    oof: dict[str, DataFrame] = {}
    stacking = config.combine in ("select", "meta")

    def fit_kmers() -> None:
        ks = km.forced_k_list(config.k_list, config.forced)
        counts = materialize(km.kmer_counts(sequences, ks))
        out.kmer = fit_kmer_features(counts, labels, config)
        vectors = out.kmer.vectors(counts, folds)
        best = config.c_grid[0]
        if len(config.c_grid) > 1:
            best, out.report["kmer_grid"], oof["kmer"] = tr.search_c_scores(vectors, config.c_grid, config.balanced)
        elif stacking:
            oof["kmer"] = tr.out_of_fold(vectors, scaled_logistic(best, config.balanced).fit)
        out.kmer_model = scaled_logistic(best, config.balanced).fit(vectors)

    def fit_clones() -> None:
        presence = materialize(cl.clone_presence(sequences))
        if stacking and "clone" in families:
            oof["clone"] = out_of_fold_clone_scores(presence, folds, config.n_folds, config.gate)
        out.clone_model = fit_clone_model(presence, labels, config.gate)

    def fit_embeddings() -> None:
        own = lookup_join(embeddings, labels.select(ID), [ID], "left_semi")  # before anything is pooled
        variants = {
            name: materialize(folds.join(vectors, ID))
            for name, vectors in embedding_variants(own, config.embedding_variants).items()
        }
        variant, model = next(iter(variants)), config.embedding_models[0]
        if len(variants) * len(config.embedding_models) > 1:
            grid = tr.search_embeddings(variants, config.embedding_models, settings_of)
            winner = tr.grid_winner(grid).first()
            variant, model = winner["variant"], winner["model"]
            out.report["embedding_grid"] = grid
        settings = settings_of.get(model, {})
        estimator = scaled(model, **settings) if config.scale_embeddings else Pipeline(stages=[classifier(model, **settings)])
        if stacking:
            oof["embedding"] = tr.out_of_fold(variants[variant], estimator.fit)
        out.embedding_variant, out.embedding_model = variant, estimator.fit(variants[variant])

    parts = [
        part for part, wanted in (
            (fit_kmers, "kmer" in families or config.important == "weights"),
            (fit_clones, "clone" in families or config.important == "clones"),
            (fit_embeddings, "embedding" in families),
        ) if wanted
    ]
    # no family needs another's results: one that waits for a step's sums leaves the cores to the others
    tr.side_by_side(labels.sparkSession, parts)

    if stacking:
        stacked = materialize(tr.stack({m: oof[m] for m in families}))
        out.meta_model = tr.fit_meta(stacked, families)
        measured = materialize(tr.model_weights(stacked, out.meta_model, families))
        held = sequences.groupBy(ID).agg(F.count(F.lit(1)).alias("n_seq"))
        sizes = labels.select(ID).join(held, ID, "left").select(
            F.lit("train").alias("dataset"), F.coalesce("n_seq", F.lit(0)).alias("n_seq")
        )  # an empty repertoire has size zero
        kind = type_from_sizes(sizes).first()["dataset_type"]
        chosen = en.select_weights(measured, kind, config.selection, config.top_n_models)
        out.report |= {"oof": stacked, "weights": chosen}
        out.weights = {r["model"]: r["final_weight"] for r in chosen.toLocalIterator()}  # two or three rows
    elif config.combine == "blend":
        out.weights = dict(zip(families, config.blend))
    else:
        out.weights = {families[0]: 1.0}
    return out


def evaluate_clone_model(presence: DataFrame, labels: DataFrame, gate: cl.Gate = cl.Gate(), test_share: float = 0.2) -> DataFrame:
    """Hold-out report of the clone model: AUC, accuracies, class means and active clones, one row."""
    from bagscope.operators.metrics import classification_report, roc_auc

    split = materialize(fo.holdout_split(labels, test_share))
    model = fit_clone_model(presence, split.where("part = 'train'").select(ID, "label"), gate)
    scored = materialize(model.score(presence, split.where("part = 'test'").select(ID, "label")))
    active = int((model.classifier.coefficients.toArray() != 0).sum()) if model.classifier else 0
    report = classification_report(scored).withColumn("auc", roc_auc(scored).scalar())
    return report.withColumn("n_clones", F.lit(model.width)).withColumn("n_active", F.lit(active))



def blend_benchmark(
    counts: DataFrame, embedding_vectors: DataFrame, folds: DataFrame, config: PipelineConfig, overrides: dict | None = None
) -> DataFrame:
    """AUC per fold of the embedding model, the k-mer model and their fixed blend: (fold, model, auc).

    The k-mer vocabulary is pruned and selected anew on the training part of every fold.
    """
    from bagscope.operators.metrics import roc_auc

    name = config.embedding_models[0]
    estimator = classifier(name, **config.settings_of(overrides).get(name, {}))

    def by_embedding() -> DataFrame:
        return materialize(tr.out_of_fold(folds.join(embedding_vectors, ID), estimator.fit))

    def by_kmer(fold: int) -> DataFrame:
        features = fit_kmer_features(counts, folds.where(F.col("fold") != fold), config)
        vectors = features.vectors(counts, folds)  # of both parts, in one pass over the counts
        model = scaled_logistic(config.c_grid[0], config.balanced).fit(vectors.where(F.col("fold") != fold))
        return score_with(model, vectors.where(F.col("fold") == fold)).select(ID, "label", "fold", "score")

    fits = [by_embedding, *[partial(by_kmer, fold) for fold in range(config.n_folds)]]
    embedded, *scored = tr.side_by_side(counts.sparkSession, fits)
    stacked = tr.stack({"embedding": embedded, "kmer": reduce(DataFrame.unionByName, scored)})
    blended = en.blend(stacked, dict(zip(("embedding", "kmer"), config.blend)), "blend")
    entries = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in ("embedding", "kmer", "blend")])
    return roc_auc(materialize(blended.select("label", "fold", F.inline(entries))), by=["fold", "model"])
