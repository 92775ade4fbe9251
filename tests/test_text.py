"""Row rules, keys, screen and neighbour languages on hand-made rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.profiles import FRENCH_ENGLISH, KAZAKH_RUSSIAN
from corpusloom.operators import corpus as C


def frame(spark, rows, schema="seq long, text string"):
    return spark.createDataFrame(rows, schema)


def test_router(spark):
    cases = {
        "❤❤❤❤❤❤": ("drop", "no_letters"),
        "9:36 🤣🤣🤣": ("drop", "no_letters"),
        "9:36 керемет": ("drop", "timestamp_only"),
        "Керемет видео": ("drop", "too_few_tokens"),
        "Керемет видео рахмет": ("too_short", "below_density_threshold"),
        "Бұл өте жақсы подкаст екен": ("ok", ""),
        "Mne kajetsya Aldik otirik istoryalar": ("romanized", "latin_script"),
        "концерт билет https://a.b бәріңіз келіңіздер": ("drop", "promo"),
        "https://x.y/z керемет видео": ("too_short", "below_density_threshold"),
        "а" * 1501: ("drop", "too_few_tokens"),
        "аб " * 600: ("drop", "too_long"),
        "СКИДКИ https://a.b на всё подряд": ("drop", "promo"),
        None: ("drop", "no_letters"),
        "": ("drop", "no_letters"),
    }
    rows = C.route(C.clean_text(frame(spark, list(enumerate(cases))))).orderBy("seq").collect()
    assert [(r.status, r.reason) for r in rows] == list(cases.values())


def test_normalisation(spark):
    texts = ["Сәлем @user.name  см. https://t.me/x?y=1\n да", "ааааа!!!! 😀😀😀😀😀", "A B\tC  D", "éte İstanbul ½² ١٢", None]
    got = C.clean_text(frame(spark, list(enumerate(texts)))).orderBy("seq").collect()
    assert [r.text for r in got][:3] == ["Сәлем <USER> см. <URL> да", "ааа!!! 😀😀😀", "A B C D"]
    keys = frame(spark, list(enumerate(texts[:4]))).select("seq", T.norm_key(F.col("text")).alias("k")).orderBy("seq").collect()
    for text, r in zip(texts, keys):
        bare = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", text.lower())).strip()
        assert r.k == hashlib.md5(bare.encode()).hexdigest(), text


def test_token_key_ignores_order(spark):
    rows = frame(spark, [(0, "Керемет видео рахмет"), (1, "рахмет!!! ВИДЕО керемет"), (2, "да нет")]).select(T.token_key(F.col("text")).alias("k")).collect()
    assert rows[0].k == rows[1].k and rows[2].k is None


def test_screen(spark):
    cases = {"видео топ": (0, 0, "unknown"), "Салем конечно": (1, 1, "high"), "Мен не знаю, бұл что такое": (2, 1, "med"), "Ол айтты что это не так": (2, 3, "med"), None: (0, 0, "unknown")}
    rows = C.screen(frame(spark, [(i, t or "") for i, t in enumerate(cases)])).orderBy("seq").collect()
    assert [(r.screen_a, r.screen_b, r.screen_bucket) for r in rows] == list(cases.values())


def test_neighbours(spark):
    cases = {"Ал эмне кылат болот": "ky", "қалай болот келет": None, "болот керек": None, "Ҳамма ўзбек тили": "uz", "Дякую за щиро відео їх": "uk", "": None}
    scores = C.language_scores(frame(spark, list(enumerate(cases))))
    rows = scores.withColumn("language", C.detect()).orderBy("seq").collect()
    assert [r.language for r in rows] == list(cases.values())
    assert rows[0].ky == 6 and rows[0].evidence == 0 and rows[1].ky == 4 and rows[1].evidence == 1


def test_dedup_is_the_ordered_loop(spark):
    import random

    rng = random.Random(4)
    vocabulary = ["алма", "бала", "дала", "қала", "жол"]
    raw = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 4]))) + rng.choice(["", "!", " ?"]), f"v{rng.randrange(4)}") for i in range(400)]
    got = {r.seq: r.drop_reason for r in C.dedup(C.route(frame(spark, raw, "seq long, text string, video_id string"))).collect()}

    def key(t):
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t.lower())).strip()

    videos = {}
    for _, t, v in raw:
        videos.setdefault(key(t), set()).add(v)
    seen, orders = set(), set()
    for i, t, _ in raw:
        words = re.findall("[Ѐ-ӿa-zA-Z]+", t)
        if len(words) < 3:
            want = "too_few_tokens"
        elif len(videos[key(t)]) >= 3:
            want = "copypasta"
        elif key(t) in seen:
            want = "exact_duplicate"
        else:
            seen.add(key(t))
            order = tuple(sorted(w.lower() for w in words))
            want = "reordered_duplicate" if order in orders else None
            orders.add(order)
        assert got[i] == want, (i, t)


def test_build_gives_each_row_one_outcome(spark):
    raw = spark.createDataFrame(
        [("a", "v1", "f", "Бұл өте жақсы подкаст екен", 1), ("a", "v1", "f", "қайталанған жол", 2), ("b", "v1", "f", "Ал эмне кылат болот силер", 3), ("c", "v2", "f", "Mne kajetsya Aldik otirik", 4), ("d", "v2", "f", None, 5)],
        "comment_id string, video_id string, source_file string, text string, seq long",
    )
    done = C.build_corpus(raw)
    rows = {r.comment_id: r for r in done.collect()}
    assert {k: r.pool for k, r in rows.items()} == {"a": "clean", "b": "otherlang", "c": "romanized", "d": None}
    assert rows["b"].drop_reason == "other_language_ky" and rows["d"].drop_reason == "no_letters"
    report = {r.drop_reason: r.n for r in C.drop_report(done).collect()}
    assert report == {"other_language_ky": 1, "no_letters": 1, "total": 2}


def test_empty_tables(spark):
    raw = spark.createDataFrame([], "comment_id string, video_id string, source_file string, text string, seq long")
    done = C.build_corpus(raw)
    assert done.count() == 0 and C.drop_report(done).count() <= 1 and C.screen_by_video(C.screen(raw)).count() == 0


def test_latin_profile_keeps_latin(spark):
    row = C.route(frame(spark, [(0, "le chat est dans la maison")]), FRENCH_ENGLISH).first()
    assert row.status == "ok"


@pytest.mark.parametrize("pair", [KAZAKH_RUSSIAN, FRENCH_ENGLISH])
def test_profiles_are_consistent(pair):
    assert len(pair.accents[0]) == len(pair.accents[1])
    assert not set(pair.screen_neutral) - set(pair.screen_shared) - set(pair.screen_a)


def test_texts_are_read_once_for_the_report(spark, tmp_path):
    from corpusloom.plans import registry

    rows = [(i, "fr", "s", f"une phrase de texte numéro {i % 7} ici", 10) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("drop_report", "dedup_outcome", "corpus_outcome"):
        plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count(f"{tmp_path}/documents.parquet") <= 1, name  # the first pass is stored already


def test_languages_are_scored_from_stored_words(spark):
    from corpusloom.operators import corpus

    rows = spark.createDataFrame([(1, "Бұл өте жақсы"), (2, "")], "seq long, text string")
    got = corpus.language_scores(rows)
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString() and {r.seq: r.n for r in got.collect()} == {1: 3, 2: 0}
