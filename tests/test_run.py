import random
from dataclasses import replace

from bagscope.plans.config import CONFIGS, STANDARD
from bagscope.plans.run import analyse, choose_config


def write_folder(folder, names, labelled, seed):
    folder.mkdir()
    rng = random.Random(seed)
    rows = ["repertoire_id,filename,label_positive"]
    for i, name in enumerate(names):
        positive = i % 2 == 0
        rows.append(f"{name},{name}.tsv,{positive}")
        lines = ["junction_aa\tv_call\tj_call"]
        for j in range(8):
            text = "".join(rng.choice("ACDEFGHIKL") for _ in range(9))
            lines.append(("WWYW" + text if positive and j < 4 else text) + "\tV1\tJ1")
        (folder / f"{name}.tsv").write_text("\n".join(lines) + "\n")
    if labelled:
        (folder / "metadata.csv").write_text("\n".join(rows + ["gone,gone.tsv,True"]) + "\n")


def test_run_from_folders(spark, tmp_path):
    train, out = tmp_path / "train_dataset_4", tmp_path / "out"
    write_folder(train, [f"r{i:02d}" for i in range(24)], True, 1)
    tests = []
    for i in (1, 2):
        test = tmp_path / f"test_dataset_4_{i}"
        write_folder(test, [f"t{j}" for j in range(4)], False, 10 + i)
        tests.append(str(test))
    config = replace(CONFIGS["4"], c_grid=(1.0,), min_count=3, top_k=5)
    analyse(spark, str(train), tests, str(out), config)
    read = spark.read.option("header", True).csv(str(out / "submissions.csv"))
    rows = read.collect()
    scores = {r["dataset"] + r["ID"]: float(r["label_positive_probability"]) for r in rows if r["dataset"].startswith("test")}
    assert len(scores) == 8
    assert {r["dataset"] for r in rows} == {"test_dataset_4_1", "test_dataset_4_2", "train_dataset_4"}
    assert min(v for k, v in scores.items() if int(k[-1]) % 2 == 0) > max(v for k, v in scores.items() if int(k[-1]) % 2 == 1)
    top = [r for r in rows if r["dataset"] == "train_dataset_4"]
    assert len(top) == 5 and all(r["junction_aa"].startswith("WWYW") for r in top)


def test_known_datasets_choose_their_pipeline(spark):
    known = spark.createDataFrame([("6", str(i)) for i in range(5)], "dataset string, repertoire_id string")
    ids = spark.createDataFrame([(str(i),) for i in range(8)], "repertoire_id string")
    assert choose_config(ids, known) is CONFIGS["6"]
    assert choose_config(ids, known.where("repertoire_id < '4'")) is STANDARD
    assert choose_config(ids, None) is STANDARD
