import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from bagscope.models.encoder import embed_sequences
from bagscope.operators.clones import Gate
from bagscope.plans import pipeline
from bagscope.plans.config import CONFIGS, STANDARD
from bagscope.session import materialize


@pytest.fixture(scope="module")
def planted(spark):
    """40 labelled and 8 unlabelled repertoires; positives carry a motif and a public clone."""
    rows = spark.range(48 * 12).select(
        F.format_string("r%02d", F.floor(F.col("id") / 12)).alias("repertoire_id"),
        F.translate(F.left(F.md5(F.col("id").cast("string")), F.lit(10)), "0123456789abcdef", "ACDEFGHIKLMNPQRS").alias("base"),
        (F.floor(F.col("id") / 12) % 2 == 0).alias("positive"),
        (F.col("id") % 12).alias("n"),
    )
    text = F.when(F.col("positive") & (F.col("n") < 3), F.concat(F.lit("WWYW"), "base")).when(
        F.col("positive") & (F.col("n") == 3), F.lit("CPUBLICF")).otherwise(F.col("base"))
    sequences = materialize(rows.select("repertoire_id", text.alias("junction_aa"), F.lit("V1").alias("v_call"), F.lit("J1").alias("j_call"), "positive"))
    ids = sequences.select("repertoire_id", F.col("positive").cast("int").alias("label")).distinct()
    labels = materialize(ids.where("repertoire_id < 'r40'"))
    test = materialize(ids.where("repertoire_id >= 'r40'"))
    return sequences.drop("positive"), labels, test


def separated(predictions, test):
    rows = predictions.join(test.withColumnRenamed("repertoire_id", "ID"), "ID").collect()
    return len(rows) == 8 and min(r["label_positive_probability"] for r in rows if r["label"]) > max(
        r["label_positive_probability"] for r in rows if not r["label"])


def test_kmer_and_clone_ensemble(spark, planted, tmp_path):
    sequences, labels, test = planted
    config = replace(STANDARD, families=("kmer", "clone"), c_grid=(1.0, 0.1), min_count=5, n_folds=3, selection="cv")
    fitted = pipeline.fit(sequences, labels, config)
    assert sum(fitted.weights.values()) == pytest.approx(1.0)
    predictions = materialize(fitted.predict(sequences, test.select("repertoire_id"), dataset="test_dataset_1"))
    assert separated(predictions, test)
    top = fitted.important_sequences(sequences, "train_dataset_1", 20).collect()
    assert len(top) == 20 and sum("WW" in r["junction_aa"] or "PUBLIC" in r["junction_aa"] for r in top) == 20
    path = str(tmp_path / "model")
    fitted.save(path)
    loaded = pipeline.FittedPipeline.load(spark, path, config)
    again = loaded.predict(sequences, test.select("repertoire_id"), dataset="test_dataset_1")
    gap = predictions.join(again.select("ID", F.col("label_positive_probability").alias("p")), "ID").agg(F.max(F.abs(F.col("p") - F.col("label_positive_probability")))).first()[0]
    assert gap < 1e-9


def test_clone_only_pipeline(planted):
    sequences, labels, test = planted
    fitted = pipeline.fit(sequences, labels, replace(CONFIGS["6"], important="clones"))
    assert separated(fitted.predict(sequences, test.select("repertoire_id"), dataset="t"), test)
    assert [r["junction_aa"] for r in fitted.important_sequences(sequences, "d").collect()] == ["CPUBLICF"]
    none = pipeline.fit(sequences, labels, replace(CONFIGS["6"], important="clones", gate=Gate(min_pos=1000)))
    assert none.important_sequences(sequences, "d").count() == 0
    assert none.important_sequences(sequences, "d", 1, labels).first()["junction_aa"] == "CPUBLICF"


def test_fixed_blend_with_embeddings(planted):
    sequences, labels, test = planted
    config = replace(CONFIGS["8"], top_variance=50)
    quick = {"SVM_RBF": dict(parts=2, maxIter=10, numFeatures=50)}
    fitted = pipeline.fit(sequences, labels, config, materialize(embed_sequences(sequences)), quick)
    assert fitted.kmer.width == 50 and fitted.weights == {"embedding": 0.8, "kmer": 0.2}
    predictions = fitted.predict(sequences, test.select("repertoire_id"), embed_sequences(sequences), "t").collect()
    assert len(predictions) == 8 and all(0 <= r["label_positive_probability"] <= 1 for r in predictions)


def test_holdout_report(spark, planted):
    from bagscope.operators.clones import clone_presence

    sequences, labels, _ = planted
    report = pipeline.evaluate_clone_model(materialize(clone_presence(sequences)), labels).first()
    assert report["auc"] == 1.0 and report["n"] == 8 and report["n_clones"] == 1 and report["n_active"] == 1


def test_families_are_fitted_side_by_side(planted, monkeypatch):
    """Each family waits until the other has begun."""
    sequences, labels, _ = planted
    both = threading.Barrier(2, timeout=60)

    def awaited(original):
        def run(*args):
            both.wait()
            return original(*args)

        return run

    for name in ("fit_kmer_features", "fit_clone_model"):
        monkeypatch.setattr(pipeline, name, awaited(getattr(pipeline, name)))
    config = replace(STANDARD, families=("kmer", "clone"), c_grid=(1.0,), min_count=5, n_folds=2, combine="blend", blend=(0.5, 0.5))
    assert pipeline.fit(sequences, labels, config).weights == {"kmer": 0.5, "clone": 0.5}


def test_only_listed_repertoires_are_pooled(planted, monkeypatch):
    sequences, labels, test = planted
    pooled = []

    def pool(vectors, *args, original=pipeline.pool_bags, **names):
        pooled.append({r[0] for r in vectors.select("repertoire_id").distinct().collect()})
        return original(vectors, *args, **names)

    monkeypatch.setattr(pipeline, "pool_bags", pool)
    embeddings = materialize(embed_sequences(sequences))
    config = replace(CONFIGS["8"], top_variance=50)
    fitted = pipeline.fit(sequences, labels, config, embeddings, {"SVM_RBF": dict(parts=2, maxIter=2, numFeatures=20)})
    assert fitted.predict(sequences, test.select("repertoire_id"), embeddings, "t").count() == 8
    assert pooled == [{r[0] for r in rows.select("repertoire_id").collect()} for rows in (labels, test)]


def test_a_fold_of_the_blend_takes_its_vectors_once(planted, monkeypatch):
    from bagscope.operators.folds import stratified_folds
    from bagscope.operators.kmers import kmer_counts

    sequences, labels, _ = planted
    folds, calls = materialize(stratified_folds(labels, 2)), []

    def vectors(self, *args, original=pipeline.KmerFeatures.vectors):
        calls.append(args)
        return original(self, *args)

    monkeypatch.setattr(pipeline.KmerFeatures, "vectors", vectors)
    config = replace(CONFIGS["8"], top_variance=50, n_folds=2)
    pooled = pipeline.embedding_variants(embed_sequences(sequences), ("max_std",))["max_std"]
    quick = {"SVM_RBF": dict(parts=2, maxIter=2, numFeatures=20)}
    rows = pipeline.blend_benchmark(materialize(kmer_counts(sequences, [4])), pooled, folds, config, quick).collect()
    assert {(r["fold"], r["model"]) for r in rows} == {(f, m) for f in (0, 1) for m in ("embedding", "kmer", "blend")}
    assert len(calls) == 2 and all(0 <= r["auc"] <= 1 for r in rows)
