import random

from pyspark.sql import functions as F

from bagscope.operators import joins
from bagscope.operators.ranking import first_n_per_group, ordered_index, top_k


def test_ordered_index_is_a_global_row_number(spark):
    values = list(range(5000))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, f"s{v % 7}") for v in values], "v int, s string").repartition(9)
    rows = ordered_index(df, [F.col("s"), F.col("v").desc()]).collect()
    expected = sorted(((f"s{v % 7}", -v) for v in values))
    assert [(r["s"], -r["v"]) for r in sorted(rows, key=lambda r: r["idx"])] == expected
    assert sorted(r["idx"] for r in rows) == list(range(5000))


def test_top_k_breaks_ties_at_the_edge(spark):
    data = [(f"n{i:04d}", 1.0 if i % 3 == 0 else 0.5 if i % 3 == 1 else -i / 10) for i in range(3000)]
    df = spark.createDataFrame(data, "name string, score double")
    expected = sorted(data, key=lambda r: (-r[1], r[0]))
    for k in (1, 999, 1001, 1500, 2500, 5000):
        got = [(r["name"], r["score"]) for r in top_k(df, "score", ["name"], k).orderBy("rank").collect()]
        assert got == expected[:k]


def test_top_k_of_equal_scores_and_of_nothing(spark):
    df = spark.range(100).select(F.format_string("n%03d", "id").alias("name"), F.lit(0.0).alias("score"))
    assert [r["name"] for r in top_k(df, "score", ["name"], 3).orderBy("rank").collect()] == ["n000", "n001", "n002"]
    assert top_k(df.where("false"), "score", ["name"], 3).count() == 0


def test_first_n_per_group_with_a_hot_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 5).alias("g"), "id")
    got = {(r["g"], r["id"]) for r in first_n_per_group(df, ["g"], [F.col("id").desc()], 4).collect()}
    brute = {}
    for i in range(2000):
        brute.setdefault(0 if i < 1500 else i % 5, []).append(i)
    assert got == {(g, i) for g, ids in brute.items() for i in sorted(ids)[-4:]}


def test_top_k_with_null_nan_infinite_and_outlying_scores(spark):
    inf, nan = float("inf"), float("nan")
    data = [(f"n{i:02d}", None) for i in range(20)] + [(f"s{i}", float(i)) for i in range(10)]
    data += [("nan", nan), ("up", inf), ("up2", inf), ("down", -inf)]
    df = spark.createDataFrame(data, "name string, score double")
    expected = sorted(((n, x) for n, x in data if x is not None and x == x), key=lambda r: (-r[1], r[0]))
    for k in (1, 2, 5, 12, 13, 40):
        got = [(r["name"], r["score"]) for r in top_k(df, "score", ["name"], k).orderBy("rank").collect()]
        assert got == expected[:k]


def test_top_k_looks_again_where_scores_cluster(spark):
    df = spark.range(200_000).select("id", F.when(F.col("id") == 7, 1e12).otherwise(F.col("id") / 1e9).alias("score"))
    got = [r["id"] for r in top_k(df, "score", ["id"], 3).orderBy("rank").collect()]
    assert got == [7, 199_999, 199_998]


def test_salted_join_equals_broadcast_join(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise((F.col("id") % 9).cast("string")).alias("key"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, 9990 + i) for i in range(150)], "key string, id long"))
    table = spark.createDataFrame([("hot", 1), ("3", 2), (None, 3), ("unused", 4)], "key string, value int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        for null_safe in (False, True):
            small = joins.lookup_join(rows, table, ["key"], how, null_safe)
            large = joins.lookup_join(rows, table, ["key"], how, null_safe, broadcast_rows=0, salts=8, hot_rows=100)
            assert small.columns == large.columns
            assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect())), (how, null_safe)


def test_only_measured_hot_keys_are_salted(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, -1).otherwise(F.col("id")).alias("key"), "id")
    table = spark.range(-1, 20_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    for hot_rows, salted in ((100, True), (1000, False)):
        joined = joins.lookup_join(rows, table, ["key"], broadcast_rows=0, hot_rows=hot_rows)
        assert ("__salt" in joined._jdf.queryExecution().optimizedPlan().toString()) == salted
        assert joined.where("value <> key * 2").count() == 0 and joined.count() == 20_000


def test_small_inputs_are_spread_and_no_others(spark, tmp_path, monkeypatch):
    from bagscope import session

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(df, "id").rdd.getNumPartitions() == 4
    monkeypatch.setattr(session, "SMALL_INPUT", 10)
    assert session.spread(df, "id").rdd.getNumPartitions() == 1


def test_intermediate_tables_are_released(spark, monkeypatch):
    import os

    from bagscope import session

    stored = session.materialize(spark.range(5))
    path = stored.inputFiles()[0].removeprefix("file://")
    assert stored.count() == 5 and path.startswith(session.shared_folder(spark))
    monkeypatch.setattr(session, "shared_folder", lambda _: path.rsplit("/", 2)[0] + "/released")
    other = session.materialize(spark.range(5)).inputFiles()[0].removeprefix("file://")
    session.release(spark)
    assert not os.path.exists(other) and os.path.exists(path)


def test_documents_come_by_id_in_small_parts_and_counts_need_no_other_shuffle(spark, tmp_path, monkeypatch):
    from bagscope import session
    from bagscope.operators.kmers import kmer_counts
    from bagscope.plans import tables

    rows = [(i, f"alpha beta w{i} alpha", "en") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(session, "SMALL_INPUT", 0)
    monkeypatch.setattr(session, "PART_BYTES", 500)
    assert tables.documents(spark, str(tmp_path)).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    counts = kmer_counts(tables.sequences(spark, str(tmp_path)), [3, 4])
    found = {(r.repertoire_id, r.kmer): r.cnt for r in counts.collect()}
    assert found[7, "lph"] == 2 and found[7, "beta"] == 1
    assert counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(session, "HOT_ROWS", 0)  # a key that fills a part: rows stay where they are
    assert tables.documents(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    again = kmer_counts(tables.sequences(spark, str(tmp_path)), [3, 4])
    assert {(r.repertoire_id, r.kmer): r.cnt for r in again.collect()} == found
