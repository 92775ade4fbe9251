"""The lexicon and the measure, against fixed words and a plain-Python model."""

import math
import random
from collections import Counter

import pytest

from corpusloom.functions.profiles import KAZAKH_RUSSIAN
from corpusloom.operators import density as D


def fixed_model(spark):
    tags = {"керемет": "kk", "видео": "shared", "рахмет": "kk", "очень": "ru", "интересный": "ru", "выпуск": "ru", "сізге": "kk", "ол": "kk", "айтты": "kk", "что": "ru", "это": "ru", "так": "ru", "согласен": "ru", "дұрыс": "kk", "айтасың": "kk", "келісемін": "kk", "толығымен": "kk"}
    lexicon = spark.createDataFrame([(w, t, True) for w, t in tags.items()], "word string, lang string, confident boolean")
    chars = D.char_model(lexicon.selectExpr("word", "lang", "cast(5 as bigint) as n"))
    return D.DensityModel(lexicon, chars, D.stripped_forms(lexicon))


def test_published_examples(spark):
    cases = {"Керемет видео, рахмет!": (3, "mono", "kk"), "Очень интересный выпуск, рахмет сізге": (5, "med", "ru"), "Ол айтты что это не так": (5, "med", "ru"), "Согласен, дұрыс айтасың": (3, "med", "kk"), "Мен келісемін толығымен": (2, "mono", "kk"), "": (0, "", ""), None: (0, "", "")}
    rows = spark.createDataFrame(list(enumerate(cases)), "seq long, text string")
    got = D.measure(rows, fixed_model(spark)).orderBy("seq").collect()
    assert [(r.counted, r.density, r.base_lang) for r in got] == list(cases.values())


def test_character_model_formula(spark):
    seeds = spark.createDataFrame([("қала", "kk", 7), ("дала", "kk", 90), ("город", "ru", 3)], "word string, lang string, n long")
    model = D.char_model(seeds)

    def counts(items):
        ctx, gram, letters = Counter(), Counter(), set()
        for w, n in items:
            s = "^^" + w + "$"
            letters |= set(w)
            for i in range(len(s) - 2):
                ctx[s[i : i + 2]] += min(n, 50)
                gram[s[i : i + 3]] += min(n, 50)
        return ctx, gram, len(letters)

    a, b = counts([("қала", 7), ("дала", 90)]), counts([("город", 3)])

    def score(w, m):
        s = "^^" + w + "$"
        return sum(math.log((m[1][s[i : i + 3]] + 0.5) / (m[0][s[i : i + 2]] + 0.5 * m[2])) for i in range(len(s) - 2)) / (len(s) - 2)

    words = ["бала", "города", "я"]
    got = {r.word: r.llr for r in D.word_llr(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    for w in words:
        assert got[w] == pytest.approx(score(w, a) - score(w, b))


def test_fit_and_reload(spark, tmp_path):
    rng = random.Random(1)
    kk, ru = ["бұл", "өте", "жақсы", "қала", "үлкен", "мұнда"], ["это", "очень", "город", "большой", "что", "здесь"]
    rows = [(i, " ".join(rng.choice(kk if i % 2 else ru) for _ in range(8))) for i in range(300)]
    model = D.build_lexicon(spark.createDataFrame(rows, "seq long, text string"), min_documents=20, min_seeds=3)
    tags = {r.word: r.lang for r in model.lexicon.collect()}
    assert tags["қала"] == "kk" and tags["город"] == "ru"
    model.save(f"{tmp_path}/lexicon")
    again = D.DensityModel.load(spark, f"{tmp_path}/lexicon", KAZAKH_RUSSIAN)
    text = spark.createDataFrame([(0, "бұл очень үлкен город қала")], "seq long, text string")
    assert D.measure(text, again).first().asDict() == D.measure(text, model).first().asDict()
    with pytest.raises(ValueError):
        D.build_lexicon(text)


def test_fill_sheet(spark):
    sheet = spark.createDataFrame([("1", "t", "pos", "", "", ""), ("2", "t", "skip", "", "", ""), ("3", "t", "neg", "x", "ru", "")], "comment_id string, text string, sentiment string, density string, base_lang string, notes string")
    measured = spark.createDataFrame([("1", "low", "kk"), ("2", "low", "kk"), ("3", "high", "kk")], "comment_id string, density string, base_lang string")
    got = {r.comment_id: (r.density, r.base_lang) for r in D.fill_sheet(sheet, measured).collect()}
    assert got == {"1": ("low", "kk"), "2": ("", ""), "3": ("high", "ru")}


def test_common_and_other_words_count_alike(spark, monkeypatch):
    rng = random.Random(2)
    kk, ru = ["бұл", "өте", "жақсы", "қала", "үлкен", "мұнда"], ["это", "очень", "город", "большой", "что", "здесь"]
    rows = [(i, " ".join(rng.choice(kk if i % 2 else ru) for _ in range(8))) for i in range(300)]
    model = D.build_lexicon(spark.createDataFrame(rows, "seq long, text string"), min_documents=20, min_seeds=3)
    mixed = [(i, " ".join(rng.choice(kk + ru + ["слово", "zz", "сөз"]) for _ in range(9))) for i in range(60)] + [(99, ""), (100, None), (7, "город қала")]
    texts, found = spark.createDataFrame(mixed, "seq long, text string"), []
    for most in (0, 4, 1000):
        monkeypatch.setattr(D, "MOST_COMMON", most)
        found.append(sorted(map(str, D.measure(texts, model).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(mixed)
