import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import statistics as ST
from corpusloom.operators import evaluation as E


def test_kappa(spark):
    pairs = [("pos", "pos"), ("pos", "neg"), ("neg", "neg"), ("neu", "neu")]
    df = spark.createDataFrame(pairs, "va string, vb string")
    assert ST.kappa(df, "va", "vb").first().kappa == pytest.approx(7 / 11)
    swapped = spark.createDataFrame([(b, a) for a, b in pairs], "va string, vb string")
    assert ST.kappa(swapped, "va", "vb").first().kappa == pytest.approx(7 / 11)
    assert ST.kappa(spark.createDataFrame([("a", "a")] * 3, "va string, vb string"), "va", "vb").first().kappa == 1.0
    assert ST.kappa(df.limit(0), "va", "vb").first().kappa is None
    words = [r[0] for r in spark.createDataFrame([(None,), (0.9,), (0.6,), (0.5,), (0.3,), (0.1,)], "k double").select(ST.interpret(F.col("k"))).collect()]
    assert words == ["n/a", "almost perfect", "substantial", "moderate", "fair", "slight - guideline needs work"]


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "i int, p double")
    assert [r.p_holm for r in ST.holm(df).orderBy("i").collect()] == pytest.approx([0.03, 0.06, 0.06])
    assert ST.holm(df.limit(0)).count() == 0


def test_mcnemar(spark):
    cases = [(0, 0), (1, 5), (3, 3), (10, 25), (40, 61), (900, 1000), (0, 7)]
    df = spark.createDataFrame(cases, "a long, b long")

    def exact(a, b):
        n = a + b
        return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(a, b) + 1)) / 2**n)

    got = [r[0] for r in df.select(ST.mcnemar_p(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([exact(*c) for c in cases], rel=1e-9)


def test_wilson(spark):
    df = spark.createDataFrame([(8, 10), (0, 0)], "k int, n int").select(ST.wilson(F.col("k"), F.col("n")).alias("w"))
    rows = df.collect()
    assert (rows[0].w.low, rows[0].w.high) == pytest.approx((0.4902, 0.9433), abs=1e-4)
    assert (rows[1].w.low, rows[1].w.high) == (0.0, 0.0)


PRED = "comment_id string, gold string, density string, n_tokens int, representation string, classifier string, fold int, pred string"


@pytest.fixture(scope="module")
def predictions(spark):
    labels = ("pos", "neg", "neu")
    rows = []
    for i in range(240):
        gold = labels[i * i % 3]
        for rep, wrong in (("a", 4), ("b", 7)):
            rows.append((str(i), gold, ("mono", "low", "med", "high")[i % 4], i % 13, rep, "logreg", 1, labels[(labels.index(gold) + (i % wrong == 0)) % 3]))
    rows.append(("only-a", "pos", "mono", 3, "a", "logreg", 1, "pos"))
    return spark.createDataFrame(rows, PRED)


def test_comparison(spark, predictions):
    both = E.aligned(predictions)
    assert both.select("comment_id").distinct().count() == 240
    rows = both.where("representation = 'a'").collect()
    f1 = []
    for label in ("pos", "neg", "neu"):
        tp = sum(r.gold == label == r.pred for r in rows)
        f1.append(2 * tp / (sum(r.gold == label for r in rows) + sum(r.pred == label for r in rows)))
    got = {r.representation: r for r in E.overall(both).collect()}
    assert got["a"].macro_f1 == pytest.approx(sum(f1) / 3) and got["a"].accuracy == pytest.approx(0.75)
    best = E.best_representation(E.overall(both))
    assert best.first().best == "b"
    for m in E.margins(E.by_bucket(both), best).collect():
        assert m.margin == pytest.approx(m.best_f1 - m.rest_f1)
    tests = E.significance(both).collect()
    whole = next(t for t in tests if t.scope == "all")
    assert len(tests) == 5 and (whole.n, whole.n01, whole.n10) == (240, sum(i % 4 == 0 and i % 7 != 0 for i in range(240)), sum(i % 4 != 0 and i % 7 == 0 for i in range(240)))
    assert all(t.p_holm >= t.p for t in tests)
    matrix = {r.gold: (r.pos, r.neg, r.neu) for r in E.confusion_matrix(both.where("representation = 'b'")).collect()}
    assert sum(map(sum, matrix.values())) == 240
    length = {r.density: r for r in E.length_control(both).collect()}
    assert length["mono"].n == 60


def test_last_classifier_wins(spark, predictions):
    more = predictions.unionByName(predictions.withColumn("classifier", F.lit("svm")).withColumn("pred", F.lit("neu")))
    assert {r.pred for r in E.one_classifier(more).collect()} == {"neu"}
    assert E.one_classifier(more, "logreg").count() == predictions.count()


def test_reports(spark, predictions):
    from corpusloom.operators import report

    text = report.comparison_report(predictions)
    assert "Best: b" in text and "| a vs b | all | 240 |" in text
    with pytest.raises(ValueError):
        report.comparison_report(predictions.limit(0))


def test_label_tables(spark):
    a = spark.createDataFrame([("1", "pos", "mono"), ("2", "neg", "low"), ("3", "skip", "low"), ("4", "", "low"), ("5", " POS", "high")], "comment_id string, sentiment string, density string")
    b = spark.createDataFrame([("1", "neg", "mono"), ("2", "pos", "mono"), ("3", "pos", "low"), ("4", "pos", "low"), ("5", "pos", "skip")], "comment_id string, sentiment string, density string")
    assert E.label_pairs(a, b, "sentiment").count() == 4 and E.label_pairs(a, b, "density").count() == 4
    top = E.confusions(E.label_pairs(a, b, "sentiment")).collect()
    assert (top[0].x, top[0].y, top[0].n) == ("neg", "pos", 2)
    scores = E.detector_scores(spark.createDataFrame([("low", "mono"), ("mono", "high"), ("med", "med")], "p string, t string"), "p", "t").first()
    assert (scores.tp, scores.fp, scores.fn, scores.precision, scores.recall) == (1, 1, 1, 0.5, 0.5)
    within = E.labels_within(spark.createDataFrame([("low", "pos")] * 4 + [("low", "neg")], "d string, s string"), "d", "s").first()
    assert within.majority == 0.8 and within.degenerate
