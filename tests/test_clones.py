import decimal
import math

import pytest
from pyspark.sql import functions as F

from bagscope.functions.stats import fisher_greater, log_factorial
from bagscope.models.clone_model import fit_clone_model
from bagscope.operators import clones as cl


def exact_p(pos, neg, n_pos, n_neg):
    n, total = pos + neg, n_pos + n_neg
    hits = sum(math.comb(n_pos, x) * math.comb(n_neg, n - x) for x in range(pos, min(n_pos, n) + 1))
    return hits / math.comb(total, n)


def test_log_factorial(spark):
    ns = [0, 1, 2, 5, 19, 20, 21, 22, 100, 5000, 10**6]
    df = spark.createDataFrame([(n,) for n in ns], "n long").select("n", log_factorial(F.col("n")).alias("v"))
    for row in df.collect():
        assert row["v"] == pytest.approx(math.lgamma(row["n"] + 1), rel=1e-13, abs=1e-13)


def test_fisher_matches_exact_integers(spark):
    cases = [(3, 0, 200, 200), (5, 0, 200, 200), (5, 1, 200, 200), (8, 4, 200, 200), (0, 0, 200, 200), (200, 0, 200, 200),
             (200, 200, 200, 200), (1, 150, 200, 200), (90, 100, 200, 200), (3, 7, 50, 252), (0, 5, 10, 10), (10, 10, 10, 15),
             (5, 0, 5, 3), (2, 3, 3, 3), (400, 300, 900, 1100)]
    df = spark.createDataFrame(cases, "pos long, neg long, np long, nn long")
    rows = df.withColumn("p", fisher_greater(F.col("pos"), F.col("neg"), F.col("np"), F.col("nn"))).collect()
    for r in rows:
        assert r["p"] == pytest.approx(exact_p(r["pos"], r["neg"], r["np"], r["nn"]), rel=1e-9, abs=1e-12), r
    assert [round(r["p"], 6) for r in rows[:5]] == [0.12406, 0.03047, 0.107608, 0.190162, 1.0]


def test_fisher_far_below_the_mean_does_not_underflow(spark):
    df = spark.createDataFrame([(10, 90_000, 100_000, 100_000)], "pos long, neg long, np long, nn long")
    p = df.select(fisher_greater(F.col("pos"), F.col("neg"), F.col("np"), F.col("nn"))).first()[0]
    assert p == pytest.approx(1.0)


def decimal_p(pos, neg, n_pos, n_neg):
    """The same by all terms relative to that of ``pos``, with 60 digits."""
    carriers, one = pos + neg, decimal.Decimal(1)
    with decimal.localcontext(prec=60, Emax=10**9, Emin=-(10**9)):
        upper, lower, term = one, one * 0, one
        for x in range(pos, min(n_pos, carriers)):
            term = term * ((n_pos - x) * (carriers - x)) / ((x + 1) * (n_neg - carriers + x + 1))
            upper += term
        term = one
        for x in range(pos, max(0, carriers - n_neg), -1):
            term = term * (x * (n_neg - carriers + x)) / ((n_pos - x + 1) * (carriers - x + 1))
            lower += term
        return float(upper / (upper + lower))


def test_fisher_at_a_million_labels(spark):
    half = 500_000
    few = [(40, 3, half, half), (150, 50, half, half), (30, 170, 100_000, 900_000)]
    many = [(1_050, 950, half, half), (1_000, 1_000, half, half), (100_300, 99_700, half, half), (251_000, 249_000, half, half), (249_000, 251_000, half, half), (252_500, 247_500, half, half),
            (20_400, 180_000, 100_000, 900_000)]
    df = spark.createDataFrame(few + many, "pos long, neg long, np long, nn long")
    args = [F.col(c) for c in ("pos", "neg", "np", "nn")]
    rows = {tuple(r)[:4]: r["p"] for r in df.withColumn("p", fisher_greater(*args)).collect()}
    for case in few:
        assert rows[case] == pytest.approx(exact_p(*case), rel=1e-12), case
    for case in many:
        assert rows[case] == pytest.approx(decimal_p(*case), rel=1e-12), case
    far = spark.createDataFrame([(400_000, 100_000, half, half), (100_000, 400_000, half, half)], "pos long, neg long, np long, nn long")
    assert [r[0] for r in far.select(fisher_greater(*args)).collect()] == [0.0, 1.0]


def test_fisher_sums_no_more_than_its_width(spark):
    case = spark.createDataFrame([(251_000, 249_000, 500_000, 500_000)], "pos long, neg long, np long, nn long")
    p = fisher_greater(*[F.col(c) for c in ("pos", "neg", "np", "nn")])
    seen = []
    plain = F.sequence
    try:
        F.sequence = lambda start, stop, *step: seen.append((start, stop)) or plain(start, stop, *step)
        fisher_greater(*[F.col(c) for c in ("pos", "neg", "np", "nn")])
    finally:
        F.sequence = plain
    lengths = case.select(*[stop - start + 1 for start, stop in seen]).first()
    assert len(lengths) == 2 and max(lengths) < 10_000  # the tail has 249,001 terms
    assert 0 < case.select(p).first()[0] < 1


def test_presence_and_counts_are_null_safe(tiny, tiny_labels):
    presence = cl.clone_presence(tiny)
    assert presence.count() == 9  # one repeated clone counts once
    rows = {tuple(r)[:3]: (r["pos"], r["neg"]) for r in cl.clone_counts(presence, tiny_labels).collect()}
    assert rows["CASSLEETQYF", "V1", "J1"] == (2, 0)
    assert rows[None, "V1", "J1"] == (1, 1)
    assert rows["CA", "V3", None] == (1, 0)
    assert ("CASSLQ", "V1", "J1") not in rows  # only seen in a negative repertoire


def test_gate_reasons_in_order(spark, tiny_labels):
    labels = spark.createDataFrame([(str(i), int(i < 200)) for i in range(400)], "repertoire_id string, label int")
    counts = spark.createDataFrame(
        [("rare", "V", "J", 2, 5), ("common", "V", "J", 9, 1), ("weak", "V", "J", 3, 0), ("good", "V", "J", 5, 0)],
        "junction_aa string, v_call string, j_call string, pos long, neg long",
    )
    stats = cl.clone_stats(counts, labels)
    assert {r["junction_aa"]: r["reason"] for r in stats.collect()} == {
        "rare": "too_rare", "common": "too_common", "weak": "not_significant", "good": "kept"}
    assert cl.funnel(stats).first().asDict() == dict(checked=4, too_rare=1, too_common=1, not_significant=1, kept=1)
    loose = cl.clone_stats(counts, labels, cl.Gate(3, 0, 1.0))
    assert {r["junction_aa"] for r in cl.kept_clones(loose).collect()} == {"weak", "good"}
    assert [r["junction_aa"] for r in cl.strongest(loose, 1).collect()] == ["good"]


def test_p_falls_with_more_positives(spark):
    df = spark.range(0, 50).select(F.col("id").alias("pos"), F.lit(5).cast("long").alias("neg"))
    fifty, sixty = F.lit(50).cast("long"), F.lit(60).cast("long")
    ps = [r["p"] for r in df.withColumn("p", fisher_greater(F.col("pos"), F.col("neg"), fifty, sixty)).orderBy("pos").collect()]
    assert all(a >= b for a, b in zip(ps, ps[1:]))


def test_matrix_and_frequencies(spark, tiny, tiny_labels):
    selected = spark.createDataFrame([(None, "V1", "J1", 0), ("CASSF", "V1", "J2", 1)], "junction_aa string, v_call string, j_call string, idx long")
    held = {tuple(r) for r in cl.clone_matrix(cl.clone_presence(tiny), selected).collect()}
    assert held == {("b", 0), ("c", 0), ("a", 1)}
    copies = {tuple(r)[:3]: r["n"] for r in cl.clone_frequency(tiny, tiny_labels).collect()}
    once = {tuple(r)[:3]: r["n"] for r in cl.clone_frequency(cl.clone_presence(tiny), tiny_labels).collect()}
    assert copies["CASSF", "V1", "J2"] == 2 and once["CASSF", "V1", "J2"] == 1


def test_clone_model_separates_and_falls_back(spark, tmp_path):
    rows, labels = [], []
    for i in range(30):
        rep, positive = f"r{i:02d}", i % 2
        labels.append((rep, positive))
        rows.append((rep, f"OWN{i}", "V", "J"))
        if positive:
            rows += [(rep, "PUBLIC", "V", "J"), (rep, "PUBLIC", "V", "J")]
    sequences = spark.createDataFrame(rows, "repertoire_id string, junction_aa string, v_call string, j_call string")
    labels = spark.createDataFrame(labels, "repertoire_id string, label int")
    presence = cl.clone_presence(sequences)
    model = fit_clone_model(presence, labels)
    assert model.width == 1
    path = str(tmp_path / "clone")
    model.save(path)
    for m in (model, type(model).load(spark, path)):
        scores = m.score(presence, labels).collect()
        assert min(r["score"] for r in scores if r["label"] == 1) > max(r["score"] for r in scores if r["label"] == 0)
    none = fit_clone_model(presence, labels, cl.Gate(min_pos=1000))
    assert {r["score"] for r in none.score(presence, labels).collect()} == {0.5}


def test_fold_counts_by_subtraction_equal_counts_of_each_training_set(spark):
    import random

    from bagscope.models.clone_model import fit_clone_model, out_of_fold_clone_scores
    from bagscope.session import materialize

    rng = random.Random(3)
    ids = [f"r{i}" for i in range(60)]
    folds = spark.createDataFrame([(r, int(i % 2), i % 3) for i, r in enumerate(ids)], "repertoire_id string, label int, fold int")
    held = [(r, f"C{c}", None if c % 5 == 0 else "V", "J") for i, r in enumerate(ids) for c in range(30) if rng.random() < (0.5 if i % 2 and c < 8 else 0.1)]
    presence = materialize(spark.createDataFrame(held, "repertoire_id string, junction_aa string, v_call string, j_call string").distinct())
    gate = cl.Gate(3, None, 0.05)
    got = cl.fold_clone_counts(presence, folds, 3)
    stats = cl.fold_clone_stats(got, folds, gate)
    scores = {r.repertoire_id: r for r in out_of_fold_clone_scores(presence, folds, 3, gate).collect()}
    assert len(scores) == 60
    for fold in range(3):
        train = folds.where(f"fold <> {fold}").select("repertoire_id", "label")
        own = cl.clone_counts(presence, train)
        key = lambda rows: sorted(map(tuple, rows), key=repr)
        assert key(got.where(f"fold = {fold}").drop("fold").collect()) == key(own.collect())
        want = cl.clone_stats(own, train, gate)
        columns = want.columns
        assert key(stats.where(f"fold = {fold}").select(columns).collect()) == key(want.collect())
        model = fit_clone_model(presence, train, gate)
        for r in model.score(presence, folds.where(f"fold = {fold}")).collect():
            assert abs(scores[r.repertoire_id].score - r.score) < 1e-6 and scores[r.repertoire_id].fold == fold
    exchanges = got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges == 1


@pytest.mark.parametrize("name, scored", [("clone_holdout", []), ("clone_model_scores", [None])])
def test_clone_queries_store_the_presence_of_labelled_documents_only(spark, tmp_path, monkeypatch, name, scored):
    from bagscope.plans import registry, tables

    folder = str(tmp_path)
    texts = [(i, f"alpha {'beta' if i % 2 else 'gamma'} w{i}", "en") for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    asked, stored, plain, keep = [], [], tables.sequences, registry.materialize
    monkeypatch.setattr(tables, "sequences", lambda spark, sf_dir, part=None: asked.append(part) or plain(spark, sf_dir, part))
    monkeypatch.setattr(registry, "materialize", lambda df: stored.append(keep(df)) or stored[-1])
    registry.QUERIES[name](spark, folder).collect()
    listed = tables.labels(spark, folder)
    assert asked == ["train", *scored]
    assert len(stored) == 1 and stored[0].join(listed, "repertoire_id", "left_anti").isEmpty()
