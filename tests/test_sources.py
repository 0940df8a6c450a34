import pytest
from pyspark.sql import functions as F

from bagscope.operators import kmers as km
from bagscope.sources import repertoires as rp
from bagscope.sources import store as sk
from bagscope.operators import importance as im


@pytest.fixture()
def folder(tmp_path):
    train = tmp_path / "train_dataset_1"
    train.mkdir()
    (train / "metadata.csv").write_text(
        "repertoire_id,filename,label_positive,age\nr1,r1.tsv,True,31\nr2,r2.tsv,False,x\nr3,r3.tsv,True,\nr4,r4.tsv,False,5\n"
    )
    (train / "r1.tsv").write_text("junction_aa\tv_call\tj_call\nCASSF\tV1\tJ1\nNA\tV1\tJ1\nCASSF\tV1\tJ1\n")
    (train / "r2.tsv").write_text("extra\tj_call\tjunction_aa\tv_call\n1\tJ2\tCASSLQ\tV2\n2\t\tCA\tnull\n")
    (train / "r3.tsv").write_text("junction_aa\tv_call\tj_call\n")
    (train / "unlisted.tsv").write_text('junction_aa\tv_call\tj_call\n"CA\tSS"\tV9\tJ9\n')
    test = tmp_path / "test_dataset_1_2"
    test.mkdir()
    (test / "t1.tsv").write_text("junction_aa\tv_call\tj_call\nCASSF\tV1\tJ1\n")
    return tmp_path


def test_files_with_different_headers(spark, folder):
    rows = {tuple(r) for r in rp.read_sequences(spark, str(folder / "train_dataset_1")).collect()}
    assert rows == {
        ("train_dataset_1", "r1", "CASSF", "V1", "J1"), ("train_dataset_1", "r1", None, "V1", "J1"),
        ("train_dataset_1", "r2", "CASSLQ", "V2", "J2"), ("train_dataset_1", "r2", "CA", None, None),
        ("train_dataset_1", "unlisted", "CA\tSS", "V9", "J9"),
    }


def test_many_directories_in_one_read(spark, folder):
    read = rp.read_sequences(spark, [str(folder / "train_dataset_1"), str(folder / "test_dataset_1_2")])
    assert {r["dataset"] for r in read.select("dataset").distinct().collect()} == {"train_dataset_1", "test_dataset_1_2"}
    assert read.count() == 7


def test_known_header_is_enforced(spark, folder):
    header = "junction_aa\tv_call\tj_call"
    assert rp.read_sequences(spark, str(folder / "test_dataset_1_2"), header=header).count() == 1
    with pytest.raises(Exception, match="(?i)header"):
        rp.read_sequences(spark, str(folder / "train_dataset_1"), header=header).select("junction_aa", "v_call", "j_call").collect()


def test_metadata_and_gaps(spark, folder):
    train = str(folder / "train_dataset_1")
    metadata = rp.read_metadata(spark, f"{train}/metadata.csv", labelled=True)
    assert {(r["repertoire_id"], r["label"], r["age"]) for r in metadata.collect()} == {("r1", 1, 31), ("r2", 0, None), ("r3", 1, None), ("r4", 0, 5)}
    gaps = {tuple(r) for r in rp.validate_inputs(spark, train, [str(folder / "test_dataset_1_2")]).collect()}
    assert gaps == {("r4", "missing_file"), ("unlisted", "not_in_metadata")}
    full = rp.full_dataset(rp.read_sequences(spark, train), metadata)
    assert {(r["ID"], r["label_positive"]) for r in full.select("ID", "label_positive").distinct().collect()} == {("r1", True), ("r2", False)}
    assert {r[0] for r in rp.repertoire_ids(spark, train).collect()} == {"r1", "r2", "r3", "unlisted"}
    filled = km.zero_filled(metadata.select("repertoire_id"), km.kmer_counts(rp.read_sequences(spark, train), [3]))
    assert filled.where("repertoire_id = 'r3'").first()["cnt"] == 0


@pytest.mark.parametrize("text", ["ID\nx\n", "filename\nx.tsv\n"])
def test_metadata_keys(spark, tmp_path, text):
    (tmp_path / "metadata.csv").write_text(text)
    metadata = rp.read_metadata(spark, str(tmp_path / "metadata.csv"))
    assert metadata.first()["repertoire_id"] == "x" and "label" not in metadata.columns
    with pytest.raises(rp.InvalidInput):
        rp.read_metadata(spark, str(tmp_path / "metadata.csv"), labelled=True)


def test_validation_errors(spark, folder, tmp_path):
    with pytest.raises(rp.InvalidInput):
        rp.validate_inputs(spark, str(tmp_path / "absent"), [])
    with pytest.raises(rp.InvalidInput):
        rp.validate_inputs(spark, str(folder / "test_dataset_1_2"), [])  # no metadata
    labels = spark.createDataFrame([("zzz", 1)], "repertoire_id string, label int")
    with pytest.raises(rp.InvalidInput):
        rp.with_label(rp.read_sequences(spark, str(folder / "test_dataset_1_2")), labels)


def test_feature_store_computes_only_what_is_missing(spark, tmp_path):
    store, built = sk.FeatureStore(spark, str(tmp_path / "store")), []

    def build(datasets):
        built.append(datasets)
        return spark.createDataFrame([(d, i) for d in datasets for i in range(3)], "dataset string, x int")

    assert store.ensure("f", ["01"], build).count() == 3
    assert store.ensure("f", ["01", "2"], build).count() == 6
    assert store.ensure("f", ["2"], build).count() == 3
    assert built == [["01"], ["2"]]


def test_sinks(spark, tmp_path):
    scores = spark.createDataFrame([("r2", 0.25), ("r1", 0.5)], "repertoire_id string, score double")
    predictions = im.as_prediction_rows(scores, "test_dataset_1")
    ranked = spark.createDataFrame([(i, f"S{i}", "V", "J") for i in range(1, 12)], "rank long, junction_aa string, v_call string, j_call string")
    sequences = im.as_result_rows(ranked, "train_dataset_1")
    path = str(tmp_path / "submission")
    sk.save_submission([predictions], [sequences], path)
    lines = []
    for part in sorted((tmp_path / "submission").glob("part-*")):
        lines += part.read_text().splitlines()[1:]
    assert lines[:2] == ["r1,test_dataset_1,0.5,-999.0,-999.0,-999.0", "r2,test_dataset_1,0.25,-999.0,-999.0,-999.0"]
    assert [line.split(",")[0] for line in lines[2:]] == [f"train_dataset_1_seq_top_{i}" for i in range(1, 12)]
    with pytest.raises(ValueError):
        sk.save_predictions(predictions.where("false"), str(tmp_path / "none"))
    sk.save_submission([predictions.where("false")], [], str(tmp_path / "empty"))
    assert spark.read.csv(str(tmp_path / "empty"), header=True).columns == predictions.columns


def test_only_first_lines_are_headers_and_unusable_files_are_not_read(spark, tmp_path):
    folder = tmp_path / "train_dataset_9"
    folder.mkdir()
    files = {
        "plain.tsv": "junction_aa\tv_call\tj_call\nCAS\tV1\tJ1\n",
        "quoted.tsv": '"v_call"\t"junction_aa"\t"j_call"\nV2\tCQQ\tJ2\n',
        "missing.tsv": "v_call\tj_call\nV3\tJ3\n",
        "twice.tsv": "junction_aa\tv_call\tj_call\nCTT\tV4\tJ4\njunction_aa\tv_call\tj_call\n",
        "b+b [1].tsv": "j_call\tx\tjunction_aa\tv_call\nJ5\tq\tCBB\tV5\n",
        "empty.tsv": "",
        "only.tsv": "junction_aa\tv_call\tj_call\n",
    }
    for name, text in files.items():
        (folder / name).write_text(text)
    got = sorted(tuple(r) for r in rp.read_sequences(spark, str(folder)).select("repertoire_id", "junction_aa", "v_call", "j_call").collect())
    assert got == [
        ("b+b [1]", "CBB", "V5", "J5"), ("plain", "CAS", "V1", "J1"), ("quoted", "CQQ", "V2", "J2"),
        ("twice", "CTT", "V4", "J4"), ("twice", "junction_aa", "v_call", "j_call"),
    ]
    assert {r[0] for r in rp.repertoire_ids(spark, str(folder)).collect()} == {"plain", "quoted", "twice", "b+b [1]", "only"}
    (folder / "metadata.csv").write_text("repertoire_id,label_positive\nplain,True\n")
    gaps = {tuple(r) for r in rp.validate_inputs(spark, str(folder), []).collect()}
    assert ("missing", "unusable_file") in gaps and ("twice", "not_in_metadata") in gaps


def test_store_reads_only_what_its_manifest_holds(spark, tmp_path):
    store, built = sk.FeatureStore(spark, str(tmp_path / "store")), []

    def build(names, n=2):
        built.append(list(names))
        return spark.createDataFrame([(d, i) for d in names if d != "empty" for i in range(n)], "dataset string, x int")

    assert store.ensure("f", ["a", "empty"], build).count() == 2
    assert store.ensure("f", ["a", "empty"], build).count() == 2 and built == [["a", "empty"]]  # a dataset without rows is not built again
    # a write that was lost before its manifest: its rows are there, and are not read
    build(["a", "b"]).write.partitionBy("dataset").parquet(f"{store.path('f')}/data/write_id=lost")
    assert store.present("f", ["a", "b"]) == {"a"}
    assert store.ensure("f", ["a", "b"], build).count() == 4 and built[-1] == ["b"]
    # other settings are other features
    assert store.ensure("f", ["a"], lambda names: build(names, 5), settings="k=4").count() == 5
    assert store.ensure("f", ["a"], build).count() == 2 and store.read("f", settings="k=4").count() == 5
    # the last write of a dataset counts
    assert store.write("f", build(["a"], 7)).where("dataset = 'a'").count() == 7
    assert store.read("f", ["empty"]).columns == ["x", "dataset"] or store.read("f", ["empty"]).count() == 0
    with pytest.raises(LookupError):
        store.read("never")


def test_a_damaged_dataset_is_reported_and_the_rest_is_built(spark, tmp_path):
    from bagscope.plans.features import DatasetFeatures

    folders = {}
    for name, header in (("good", "junction_aa\tv_call\tj_call"), ("bad", "something\telse\there"), ("fine", "v_call\tjunction_aa\tj_call")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "r1.tsv").write_text(f"{header}\nCASSF\tV1\tJ1\n")
        folders[name] = str(folder)
    folders["gone"] = str(tmp_path / "gone")
    features = DatasetFeatures(sk.FeatureStore(spark, str(tmp_path / "store")), folders)
    got = {r.dataset: r for r in features.build_each(features.sequences).collect()}
    assert {n: (r.built, r.n_rows) for n, r in got.items()} == {"good": (True, 1), "fine": (True, 1), "bad": (False, None), "gone": (False, None)}
    assert "InvalidInput" in got["bad"].error and got["gone"].error
    assert features.sequences(["good", "fine"]).count() == 2
    (tmp_path / "bad" / "r1.tsv").write_text("junction_aa\tv_call\tj_call\nCASSF\tV1\tJ1\n")
    assert features.build_each(features.sequences, ["bad"]).first().built
