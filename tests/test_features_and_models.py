import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import features as FE
from corpusloom.operators import models as M

TEXTS = ["Жақсы видео рахмет", "жақсы жақсы подкаст", "плохое видео", "я не знаю что это видео", "", None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "comment_id long, text string")


def reference(texts, analyse, most):
    counts = [Counter(analyse((t or "").lower())) for t in texts]
    df, total = Counter(), Counter()
    for c in counts:
        df.update(c.keys())
        total.update(c)
    kept = sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t))[:most]
    out = {}
    for i, c in enumerate(counts):
        w = {t: (1 + math.log(c[t])) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in kept if c[t]}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out |= {(i, t): x / norm for t, x in w.items()}
    return out


def word_terms(text):
    w = re.findall("[Ѐ-ӿa-zA-Z]+", text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def char_terms(text):
    out = []
    for w in text.split():
        w = f" {w} "
        for n in (3, 4, 5):
            out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
            if len(w) <= n:
                break
    return out


@pytest.mark.parametrize("make, analyse", [(FE.tfidf_word, word_terms), (FE.tfidf_char, char_terms)])
@pytest.mark.parametrize("most", [5, 10_000])
def test_tfidf(spark, docs, make, analyse, most):
    got = {(r.comment_id, r.term): r.weight for r in make(max_features=most).fit(docs).transform(docs).collect()}
    want = reference(TEXTS, analyse, most)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_vectors(spark):
    vectors = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 4.0])], "word string, vector array<float>")
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (2, "zz")], "comment_id long, word string")
    got = {r.comment_id: list(r.vector) for r in FE.mean_vectors(tokens, vectors, 2).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]
    row = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0], [9.0, 9.0]], [1, 1, 0])], "s array<array<double>>, m array<int>")
    assert list(row.select(FE.masked_mean(F.col("s"), F.col("m"), 2)).first()[0]) == pytest.approx([1 / math.sqrt(5), 2 / math.sqrt(5)])
    assert {"tfidf_word", "tfidf_char", "fasttext", "xlmr"} == set(FE.REPRESENTATIONS)


def test_balanced_weights(spark):
    rows = spark.createDataFrame([(i, "pos" if i < 9 else "neg") for i in range(12)], "comment_id long, gold string")
    got = {r.gold: r.weight for r in M.balanced_weights(rows, "gold").collect()}
    assert got == {"pos": pytest.approx(12 / 18), "neg": pytest.approx(12 / 6)}


def test_cross_validation(spark):
    rows = spark.createDataFrame([(i, ("отличное видео спасибо" if i % 2 else "плохое скучное видео") + f" слово{i % 3}", "pos" if i % 2 else "neg", "mono", 3, i // 2 % 2 if i < 36 else None) for i in range(40)], "comment_id long, text string, gold string, density string, n_tokens int, fold long")
    got = M.cross_validate(rows, "tfidf_word", FE.tfidf_word, k=2).collect()
    assert len(got) == 36 and all(r.gold == r.pred for r in got) and {r.fold for r in got} == {1, 2}
    vectors = spark.createDataFrame([(i, [1.0, 0.1] if i % 2 else [0.1, 1.0]) for i in range(40)], "comment_id long, vector array<double>")
    both, missing = M.cross_validate_all(rows, {"xlmr": vectors, "fasttext": None}, ("svm",), 2)
    assert missing == ["fasttext"] and all(r.gold == r.pred for r in both.collect())
    with pytest.raises(ValueError):
        M.cross_validate(rows.limit(0), "x", FE.tfidf_word)
    with pytest.raises(ValueError):
        M.classifier("tree", 3)


def test_skipgram(spark, docs):
    got = FE.skipgram(docs, dim=4, min_count=1, epochs=1).collect()
    words = {r.word for r in got}
    assert "видео" in words and any(w.startswith("#") for w in words) and len(got[0].vector) == 4


def test_all_folds_are_predicted(spark):
    rows = spark.createDataFrame([(i, "" if i == 7 else ("good video thanks" if i % 2 else "bad dull video"), "pos" if i % 2 else "neg", "mono", 3, i % 5 if i < 40 else None) for i in range(44)], "comment_id long, text string, gold string, density string, n_tokens int, fold long")
    got = M.cross_validate(rows, "tfidf_word", FE.tfidf_word).collect()
    assert sorted((r.comment_id, r.fold) for r in got) == [(i, i % 5 + 1) for i in range(40)]
    with pytest.raises(ValueError):
        M.cross_validate(rows, "tfidf_word", FE.tfidf_word, k=2)


def test_query_predicts_all_folds(spark, monkeypatch):
    found = []
    monkeypatch.setattr(FE.Tfidf, "__init__", lambda self, terms, most, min_df=2, own=FE.Tfidf.__init__: (found.append(most), own(self, terms, most, min_df))[1])
    from corpusloom.operators import folds as FO
    from corpusloom.plans import registry
    from corpusloom.plans import roles as R

    sf_dir = "/root/testdata/sf0.001"
    rows = FO.make_folds(R.labelled(spark, sf_dir)).where("fold is not null").select("comment_id", "fold").collect()
    vectors = {r.vec_id for r in R.table(spark, sf_dir, "embeddings").select("vec_id").collect()}
    got = registry.queries()["cv_predictions"](spark, sf_dir).select("representation", "comment_id", "fold").collect()
    for name, want in (("tfidf_word", rows), ("xlmr", [r for r in rows if r.comment_id in vectors])):
        assert sorted((r.comment_id, r.fold) for r in got if r.representation == name) == sorted((r.comment_id, r.fold + 1) for r in want)
    assert set(found) == {FE.WORD_FEATURES}


@pytest.mark.parametrize("make", [FE.tfidf_word, FE.tfidf_char])
def test_terms_are_not_shuffled(spark, docs, make):
    plan = make().fit(docs).transform(docs)._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("Join", "Generate")) and plan.count("ObjectHashAggregate") <= 2


def test_texts_of_a_repeated_id_are_one_document(spark):
    rows = spark.createDataFrame([(1, "bon mot"), (1, "mot juste"), (2, "bon mot juste"), (3, None)], "comment_id long, text string")
    got = {(r.comment_id, r.term): r.weight for r in FE.tfidf_word().fit_transform(rows).collect()}
    assert set(got) == {(k, t) for k in (1, 2) for t in ("bon", "mot", "juste", "bon mot", "mot juste")} and got[1, "mot"] > got[1, "bon"]


def test_few_terms_at_once_change_nothing(spark, docs, monkeypatch):
    for name in ("MOST_TERMS", "MOST_UNITS", "MOST_ROWS"):
        monkeypatch.setattr(FE, name, 2)
    monkeypatch.setattr(FE, "TEXTS_AT_ONCE", 1)
    number, rows = {}, [[t.split() if t else []] for t in TEXTS]
    batch = FE.pa.record_batch([FE.pa.array(rows, FE.pa.list_(FE.pa.list_(FE.pa.string()))), FE.pa.array([0] * len(rows))], ["pieces", "part"])
    for units, grams in ((FE.word_units, None), (list, FE.word_grams)):
        out = [r for b in FE._seen(units, grams)(iter([batch])) for r in b.to_pylist()]
        assert len(out) > len({r["term"] for r in out})
        df, total = Counter(), Counter()
        for texts in rows:
            c = Counter(g for u in units(texts[0]) for g in (grams(u) if grams else [u]))
            df.update(c.keys())
            total.update(c)
        for name, want in (("df", df), ("total", total)):
            assert {t: sum(r[name] for r in out if r["term"] == t) for t in want} == want


def test_repeated_ids_have_one_prediction_a_row(spark):
    rows = spark.createDataFrame([(i // 2, "good video thanks" if i % 4 < 2 else "bad dull video", "pos" if i % 4 < 2 else "neg", "mono", 3, i // 2 % 5) for i in range(40)], "comment_id long, text string, gold string, density string, n_tokens int, fold long")
    got = M.cross_validate(rows, "tfidf_word", FE.tfidf_word).collect()
    assert sorted((r.comment_id, r.fold) for r in got) == sorted((i // 2, i // 2 % 5 + 1) for i in range(40)) and all(r.gold == r.pred for r in got)
