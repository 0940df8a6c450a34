import numpy as np
import pytest
from pyspark.sql import functions as F

from bagscope.operators import datasets as ds
from bagscope.operators import ensemble as en
from bagscope.operators import folds as fo
from bagscope.operators import importance as im
from bagscope.operators import metrics as me
from bagscope.operators import pooling as po


def test_pooling_small_case(spark):
    df = spark.createDataFrame([("x", [1.0, 4.0]), ("x", [3.0, 0.0]), ("y", [2.0, 2.0])], "repertoire_id string, vector array<float>")
    rows = {r["repertoire_id"]: r for r in po.pool_bags(df).collect()}
    expected = dict(mean=[2, 2], max=[3, 4], min=[1, 0], sum=[4, 4], std=[1, 2], mean_std=[2, 2, 1, 2])
    for name, value in expected.items():
        assert rows["x"][name] == pytest.approx(value)
    assert rows["y"]["std"] == pytest.approx([0, 0])
    with pytest.raises(ValueError):
        po.pool_bags(df, ["median"])


def test_pooling_matches_numpy(spark):
    rng = np.random.default_rng(0)
    bags = {f"b{i}": rng.normal(size=(n, 16)).astype("float32") for i, n in enumerate([1, 2, 50, 333])}
    rows = [(b, [float(x) for x in v]) for b, m in bags.items() for v in m]
    df = spark.createDataFrame(rows, "repertoire_id string, vector array<float>").repartition(6)
    for r in po.pool_bags(df).collect():
        m = bags[r["repertoire_id"]].astype("float64")
        for name, value in [("mean", m.mean(0)), ("max", m.max(0)), ("min", m.min(0)), ("sum", m.sum(0)), ("std", m.std(0))]:
            assert np.allclose(r[name], value, atol=1e-9), name


def test_token_pooling(spark):
    rows = [(1, [[9.0, 9.0], [1.0, 4.0], [3.0, -2.0], [8.0, 8.0]], [True, False, False, True]), (2, [[5.0, 6.0]], [True])]
    got = {r["id"]: r for r in po.pool_tokens(spark.createDataFrame(rows, "id int, tokens array<array<float>>, special array<boolean>")).collect()}
    assert got[1]["cls"] == [9, 9] and got[1]["mean"] == [2, 1] and got[1]["max"] == [3, 4]
    assert got[2]["cls"] == [5, 6] and got[2]["mean"] == [0, 0] and got[2]["max"] == [-1e9, -1e9]


def brute_auc(scores, labels):
    pos, neg = scores[labels == 1], scores[labels == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + 0.5 * (d == 0).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("kind", ["uniform", "ties", "constant", "narrow", "negative"])
def test_auc_matches_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    n = 600
    scores = {
        "uniform": rng.random(n), "ties": rng.integers(0, 4, n) / 4, "constant": np.full(n, 0.5),
        "narrow": np.where(rng.random(n) < 0.5, 1e-12 * rng.random(n), 1.0), "negative": rng.normal(size=n) * 100,
    }[kind]
    labels = (rng.random(n) < 0.3).astype(int)
    groups = rng.integers(0, 2, n)
    df = spark.createDataFrame([(float(s), int(y), int(g)) for s, y, g in zip(scores, labels, groups)], "score double, label int, g int")
    assert me.roc_auc(df).first()["auc"] == pytest.approx(brute_auc(scores, labels), abs=1e-12)
    for r in me.roc_auc(df, by=["g"]).collect():
        mask = groups == r["g"]
        assert r["auc"] == pytest.approx(brute_auc(scores[mask], labels[mask]), abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert me.roc_auc(df).first()["auc"] is None


def test_report_and_winner(spark):
    df = spark.createDataFrame([(0.9, 1), (0.4, 1), (0.2, 0), (0.6, 0), (0.1, 0)], "score double, label int")
    r = me.classification_report(df).first()
    assert r["accuracy"] == pytest.approx(0.6)
    assert r["balanced_accuracy"] == pytest.approx((0.5 + 2 / 3) / 2)
    grid = spark.createDataFrame([(0, "x", 0.5), (1, "y", 0.8), (2, "z", 0.8)], "grid_order int, name string, mean_auc double")
    assert me.grid_winner(grid).first()["name"] == "y"


def test_folds_partition_and_balance(spark):
    labels = spark.createDataFrame([(f"r{i}", int(i % 7 == 0)) for i in range(211)], "repertoire_id string, label int")
    rows = fo.stratified_folds(labels.repartition(5)).collect()
    assert sorted(r["repertoire_id"] for r in rows) == sorted(f"r{i}" for i in range(211))
    for y in (0, 1):
        sizes = [sum(r["fold"] == f and r["label"] == y for r in rows) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    again = fo.stratified_folds(labels.coalesce(1)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert {tuple(r) for r in rows} != {tuple(r) for r in fo.stratified_folds(labels, seed=7).collect()}
    split = fo.holdout_split(labels).groupBy("label", "part").count().collect()
    assert {(r["label"], r["part"]): r["count"] for r in split} == {(0, "test"): 36, (0, "train"): 144, (1, "test"): 6, (1, "train"): 25}
    weights = {r["label"]: r["weight"] for r in fo.class_weights(labels).collect()}
    assert weights == {0: pytest.approx(211 / 360), 1: pytest.approx(211 / 62)}


def test_dataset_type(spark):
    sizes = spark.createDataFrame(
        [("s", i, n) for i, n in enumerate([100, 100, 101])] + [("e", i, n) for i, n in enumerate([50, 100, 200])] + [("z", 0, 0)],
        "dataset string, repertoire_id int, n_seq int",
    )
    got = {r["dataset"]: r["dataset_type"] for r in ds.type_from_sizes(sizes).collect()}
    assert got == {"s": "synthetic", "e": "experimental", "z": "synthetic"}


def test_fingerprint_needs_more_than_half(spark):
    known = spark.createDataFrame([("1", str(i)) for i in range(3)] + [("2", str(i)) for i in range(4)], "dataset string, repertoire_id string")
    train = spark.createDataFrame([(str(i),) for i in range(6)], "repertoire_id string")
    assert ds.fingerprint_match(train, known).first()["dataset"] == "2"
    assert ds.fingerprint_match(train, known.where("dataset = '1'")).first()["dataset"] is None


def test_dataset_pairs(spark):
    train = spark.createDataFrame([("train_dataset_7",), ("train_dataset_1",)], "dataset string")
    test = spark.createDataFrame([("test_dataset_7_2",), ("test_dataset_7_1",), ("test_dataset_9",)], "dataset string")
    assert {r["dataset"]: r["tests"] for r in ds.dataset_pairs(train, test).collect()} == {
        "train_dataset_7": ["test_dataset_7_1", "test_dataset_7_2"], "train_dataset_1": []}


def weights_of(spark, weights, aucs, *rule):
    df = spark.createDataFrame([(f"m{i}", i, float(w), float(a)) for i, (w, a) in enumerate(zip(weights, aucs))], "model string, model_order int, weight double, auc double")
    return [r["final_weight"] for r in en.select_weights(df, *rule).orderBy("model_order").collect()]


def test_ensemble_rules(spark):
    assert weights_of(spark, [2, 1, -1], [0.5] * 3, "experimental") == pytest.approx([2 / 3, 1 / 3, 0])
    assert weights_of(spark, [2, -1, -3], [0.5] * 3, "experimental") == [1, 0, 0]
    assert weights_of(spark, [-1, -3, -2], [0.5] * 3, "experimental") == [0, 1, 0]
    assert weights_of(spark, [0.4, 0.35, 0.25], [0.6, 0.8, 0.7], "synthetic") == [0, 1, 0]
    assert weights_of(spark, [-4, 0.35, 0.25], [0.6, 0.8, 0.7], "synthetic") == [1, 0, 0]
    assert weights_of(spark, [0.4, 0.35, 0.25], [0.6, 0.8, 0.7], "synthetic", "weights") == [1, 0, 0]
    assert weights_of(spark, [4, 0.35, 0.25], [0.6, 0.7, 0.7], "synthetic", "cv") == [0, 1, 0]
    with pytest.raises(ValueError):
        weights_of(spark, [1], [1], "other")


def test_sequence_scores(spark):
    sequences = spark.createDataFrame([("AAAAA", "V", "J"), ("AAAAA", "V", "J"), ("AAAC", "V", None), (None, "V", "J"), ("AA", "V", "J")], "junction_aa string, v_call string, j_call string")
    weights = spark.createDataFrame([("AAA", 2.0), ("AAAC", -0.5), ("AAC", 0.0)], "kmer string, weight double")
    once = {r["junction_aa"]: r["importance_score"] for r in im.score_sequences(sequences, weights, [3, 4]).collect()}
    assert once == {"AAAAA": 2.0, "AAAC": 1.5, None: 0.0, "AA": 0.0}
    every = {r["junction_aa"]: r["importance_score"] for r in im.score_sequences(sequences, weights, [3, 4], distinct_kmers=False).collect()}
    assert every == {"AAAAA": 6.0, "AAAC": 1.5, None: 0.0, "AA": 0.0}
    top = im.top_sequences(im.score_sequences(sequences, weights, [3, 4]), "train_dataset_9", 2).orderBy("ID").collect()
    assert [(r["ID"], r["junction_aa"]) for r in top] == [("train_dataset_9_seq_top_1", "AAAAA"), ("train_dataset_9_seq_top_2", "AAAC")]
    filled = im.fill_sentinels(im.top_sequences(im.score_sequences(sequences, weights, [3, 4]), "d", 1)).first()
    assert filled["label_positive_probability"] == -999.0 and filled["junction_aa"] == "AAAAA"


def test_scoring_shuffles_sequences_once(spark):
    text = F.md5(F.col("id").cast("string"))
    sequences = spark.range(1000).select(text.alias("junction_aa"), F.left(text, F.lit(2)).alias("v_call"), F.right(text, F.lit(1)).alias("j_call"))
    weights = spark.createDataFrame([("abc", 1.0)], "kmer string, weight double")
    plan = im.score_sequences(sequences, weights, [3, 4])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(junction_aa") == 1


def test_roc_auc_leaves_unusable_rows_out_and_takes_clustered_scores(spark):
    import random

    from bagscope.operators.metrics import roc_auc

    rng = random.Random(1)
    data = [("a", rng.choice([0.1, 0.2, 0.2000001, 1e9]), rng.randint(0, 1)) for _ in range(400)]
    data += [("b", 0.5, i % 2) for i in range(10)] + [("c", 0.3, 1), ("c", 0.4, 1)]
    odd = [("a", None, 1), ("a", float("nan"), 0), ("a", 0.3, None), ("a", float("inf"), 1), ("a", float("-inf"), 0)]

    def brute(rows):
        up, down = [x for x, y in rows if y == 1], [x for x, y in rows if y == 0]
        return sum((p > n) + (p == n) / 2 for p in up for n in down) / (len(up) * len(down)) if up and down else None

    df = spark.createDataFrame(data + odd, "g string, score double, label int").repartition(7)
    want = {g: brute([(x, y) for h, x, y in data + odd[3:] if h == g]) for g in "abc"}
    got = {r["g"]: r["auc"] for r in roc_auc(df, by=["g"]).collect()}
    assert got.keys() == want.keys() and got["c"] is None
    assert abs(got["a"] - want["a"]) < 1e-12 and got["b"] == 0.5


def test_roc_auc_moves_no_rows_by_the_group_alone(spark):
    from bagscope.operators.metrics import roc_auc

    df = spark.range(1000).select((F.col("id") % 7 / 7).alias("score"), (F.col("id") % 2).cast("int").alias("label"))
    plan = roc_auc(df)._jdf.queryExecution().sparkPlan().toString()
    assert "Window" in plan and "__part" in plan


def test_kernel_width_is_that_of_standardised_features(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from bagscope.models import zoo

    rng = np.random.default_rng(0)
    rows = [(str(i), i % 2, Vectors.dense(rng.normal([5, -3, 40, 0], [1, 2, 3, 4]).tolist())) for i in range(80)]
    df = spark.createDataFrame(rows, ["repertoire_id", "label", "features"])
    model = zoo.scaled("SVM_RBF", numFeatures=16, parts=2, maxIter=3).fit(df)
    fourier = model.stages[1].stages[0]
    assert abs(fourier.getOrDefault(fourier.gamma) - 0.25) < 1e-9


def test_pipeline_8_uses_its_own_strength():
    from bagscope.plans.config import CONFIGS, PipelineConfig

    config = CONFIGS["8"]
    assert config.settings_of()["SVM_RBF"]["C"] == 0.5
    assert config.settings_of({"SVM_RBF": {"parts": 2}})["SVM_RBF"] == {"C": 0.5, "parts": 2}
    import json
    from dataclasses import asdict

    for one in CONFIGS.values():
        assert PipelineConfig.of(json.loads(json.dumps(asdict(one)))) == one
