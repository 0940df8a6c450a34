"""A whole run: train and test folders in, predictions and important sequences out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagscope.models.encoder import Encoder
from bagscope.operators.datasets import fingerprint_match
from bagscope.plans.config import CONFIGS, STANDARD, PipelineConfig
from bagscope.plans.features import DatasetFeatures
from bagscope.plans.pipeline import FittedPipeline, fit
from bagscope.sources import repertoires as rp
from bagscope.sources import store as sk


def choose_config(train_ids: DataFrame, known: DataFrame | None) -> PipelineConfig:
    """The pipeline of a known dataset when most train ids belong to it, else the standard one."""
    if known is None:
        return STANDARD
    match = fingerprint_match(train_ids, known).first()["dataset"]
    return CONFIGS.get(match, STANDARD)


def analyse(
    spark: SparkSession,
    train_dir: str,
    test_dirs: Sequence[str],
    out_dir: str,
    config: PipelineConfig | None = None,
    known: DataFrame | None = None,
    make_encoder: Callable[[], Encoder] | None = None,
    overrides: dict | None = None,
) -> FittedPipeline:
    """Validate, build features, fit, predict all test folders at once, and write every output.

    ``known`` is (dataset, repertoire_id) of datasets with a pipeline of their own. Without an encoder the
    embedding family is left out. Results go to ``out_dir``: predictions and important sequences as TSV,
    both as one submission CSV, the fitted model, the kept clones' statistics and the feature tables.
    """
    headers = rp.read_headers(spark, [train_dir, *test_dirs])
    gaps = rp.validate_inputs(spark, train_dir, test_dirs, headers)
    metadata = rp.read_metadata(spark, f"{train_dir}/metadata.csv", labelled=True)
    config = config or choose_config(metadata, known)
    train = rp.folder_name(train_dir)
    tests = {rp.folder_name(d): d for d in test_dirs}
    store = sk.FeatureStore(spark, f"{out_dir}/features")
    features = DatasetFeatures(store, {train: train_dir, **tests}, headers)

    sequences = features.sequences([train])
    absent = gaps.where("problem = 'missing_file'")
    labels = rp.label_table(metadata).join(absent, "repertoire_id", "left_anti")
    embeddings = None
    if make_encoder is not None and "embedding" in config.families:
        embeddings = features.embeddings([train], make_encoder)
    fitted = fit(sequences, labels, config, embeddings, overrides)
    fitted.save(f"{out_dir}/model")
    if fitted.clone_model is not None:
        sk.save_clone_stats(fitted.clone_model.selected, f"{out_dir}/clone_stats")

    important = fitted.important_sequences(sequences, train, labels=labels)
    sk.save_important_sequences(important, f"{out_dir}/{train}_important_sequences.tsv")
    predictions = []
    if tests:
        ids = headers.where("usable").where(F.col("dataset").isin(list(tests))).select("dataset", "repertoire_id").distinct()
        test_vectors = None if embeddings is None else features.embeddings(sorted(tests), make_encoder)
        predicted = fitted.predict(features.sequences(sorted(tests)), ids, test_vectors)
        sk.save_predictions(predicted, f"{out_dir}/{train}_test_predictions.tsv")
        predictions.append(read_predictions(spark, f"{out_dir}/{train}_test_predictions.tsv"))
    sk.save_submission(predictions, [important], f"{out_dir}/submissions.csv")
    return fitted


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Saved predictions, their sentinel columns back to null."""
    schema = "ID string, dataset string, label_positive_probability double, junction_aa string, v_call string, j_call string"
    rows = spark.read.options(sep="\t", header="true", quote='"', escape='"').schema(schema).csv(path)
    empty = [F.lit(None).cast("string").alias(c) for c in ("junction_aa", "v_call", "j_call")]
    return rows.select("ID", "dataset", "label_positive_probability", *empty)
