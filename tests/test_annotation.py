import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import annotation as A
from corpusloom.operators.prompts import INSTRUCTIONS

SHEET = "file string, line long, comment_id string, text string, sentiment string, density string, base_lang string, notes string"


def sheet(spark, rows):
    return spark.createDataFrame(rows, SHEET)


def test_findings(spark):
    rows = [
        ("b1", 2, "1", "t", "pos", "mono", "kk", None),
        ("b1", 3, "2", "t", "posit", "hi", "", None),
        ("b1", 4, "", "t", "pos", "mono", "kk", None),
        ("b1", 5, "3", "t", "skip", "low", "", None),
        ("b2", 2, "1", "t", None, None, None, None),
        ("retest_1", 2, "1", "t", "pos", "mono", "kk", None),
        ("b2", 3, "9", "t", "", "", "", None),
    ]
    got = {(r.level, r.file, r.line, r.message) for r in A.findings(sheet(spark, rows), spark.createDataFrame([("1",), ("2",), ("3",)], "comment_id string")).collect()}
    assert got == {
        ("error", "b1", 3, "sentiment='posit'  (did you mean 'pos'?)"),
        ("error", "b1", 3, "density='hi'  (did you mean 'high'?)"),
        ("error", "b1", 3, "sentiment filled but base_lang blank"),
        ("error", "b1", 4, "missing comment_id"),
        ("warning", "b1", 5, "sentiment=skip but density/base_lang filled - they will be discarded"),
        ("warning", "b2", 2, "comment_id appears twice across batches"),
        ("error", "b2", 3, "comment_id not in manifest - the cell was probably edited"),
    }
    assert A.findings(sheet(spark, rows[:1])).count() == 0
    with pytest.raises(ValueError, match="notes"):
        A.require_columns(sheet(spark, rows).drop("notes"))


def test_merge(spark):
    rows = [("b1", 2, "1", "t", "POS ", "mono", "kk", "n"), ("b2", 2, "1", "t", "neg", "low", "ru", ""), ("b1", 3, "2", "t", "", "", "", ""), ("b1", 4, "3", "t", "skip", "", "", ""), ("b1", 5, "4", "t", "pos", "", "kk", ""), ("b1", 6, "5", "t", "pos", "low", "kk", "")]
    clean = spark.createDataFrame([(str(i), f"text {i}", "v", 5, True, "mono") for i in (1, 2, 3, 4)], "comment_id string, text string, video_id string, n_tokens int, density_eligible boolean, screen_bucket string")
    manifest = A.manifest_index(spark.createDataFrame([("1", "retest", "", 9), ("1", "natural", "0.5", 2), ("1", "natural", "0.7", 4)], "comment_id string, sample string, inclusion_prob string, line long"))
    got = {(r.file, r.comment_id): r for r in A.merge(sheet(spark, rows), clean, manifest).collect()}
    assert {k: r.outcome for k, r in got.items()} == {("b1", "1"): "labelled", ("b2", "1"): "repeated", ("b1", "2"): "blank", ("b1", "3"): "skipped", ("b1", "4"): "invalid", ("b1", "5"): "unknown"}
    kept = got["b1", "1"]
    assert (kept.sentiment, kept.text, kept["sample"], kept.inclusion_prob) == ("pos", "text 1", "natural", "0.7")


def test_replies(spark):
    answer = lambda i, **k: {"id": i, "sentiment": "pos", "base_lang": "kk", "confidence": "high", "note": ""} | k
    replies = [
        ("reply_01", "```json\n" + json.dumps([answer("1"), answer("1", sentiment="neg"), answer("2", sentiment="bad"), answer("2", sentiment="skip", base_lang="zz")]) + "\n```"),
        ("reply_02", "Вот ответ: " + json.dumps([answer("3", confidence="?"), answer("77"), answer("")]) + " готово"),
        ("reply_03", "nothing"),
        ("reply_04", "[1, "),
        ("reply_09", "[]"),
    ]
    index = spark.createDataFrame([("prompt_01", ["1", "2"]), ("prompt_02", ["3", "4"]), ("prompt_03", ["5"]), ("prompt_04", ["6"])], "prompt string, ids array<string>")
    accepted, problems = A.ingest(spark.createDataFrame(replies, "reply string, raw string"), index)
    assert {(r.id, r.sentiment, r.base_lang, r.confidence) for r in accepted.collect()} == {("1", "pos", "kk", "high"), ("2", "skip", "", "high"), ("3", "pos", "kk", "low")}
    got = {(r.reply, r.problem) for r in problems.collect()}
    assert got == {
        ("reply_01", "id 1 answered twice"),
        ("reply_01", "2: sentiment 'bad'"),
        ("reply_02", "id 77 was not in this prompt"),
        ("reply_02", "missing id"),
        ("reply_02", "1 of 2 comments unanswered"),
        ("reply_03", "no JSON array found"),
        ("reply_04", "invalid JSON"),
        ("reply_09", "no matching prompt"),
    }
    rows = [("b", 2, "1", "t1", "", "", "", "old"), ("b", 3, "3", "t3", "neg", "", "ru", ""), ("b", 4, "8", "t8", None, "", "", "")]
    done = {r.comment_id: r for r in A.apply_answers(sheet(spark, rows), accepted).collect()}
    assert (done["1"].sentiment, done["1"].base_lang, done["1"].density, done["1"].notes) == ("pos", "kk", "", "old")
    assert done["3"].sentiment == "neg" and done["8"].sentiment is None
    queue = {r.comment_id: r.text for r in A.audit_queue(accepted, sheet(spark, rows)).collect()}
    assert queue == {"1": "t1", "2": "", "3": "t3"}


def test_prompts(spark):
    rows = [("b", i, str(i), f'te"xt\n{i}', "pos" if i == 3 else "", "", "", "") for i in range(1, 8)]
    got = {r.prompt: r for r in A.prompts(sheet(spark, rows), INSTRUCTIONS, 4).collect()}
    assert {k: list(r.ids) for k, r in got.items()} == {"prompt_01": ["1", "2", "4", "5"], "prompt_02": ["6", "7"]}
    line = next(x for x in got["prompt_02"].body.split("\n") if x.startswith('{"id"'))
    assert json.loads(line) == {"id": "6", "text": 'te"xt 6'}


def test_keys(spark):
    rows = [("b", 1, "1", "t", "", "", "", ""), ("b", 2, "2", "t", "pos", "low", "kk", ""), ("b", 3, "3", "t", "skip", "", "", ""), ("b", 4, "4", "t", "pos", "low", "kk", "")]
    keys = spark.createDataFrame([("1", "1"), ("2", "0"), ("3", "q"), ("4", "u")], "comment_id string, key string")
    got = {r.comment_id: (r.sentiment, r.density, r.base_lang) for r in A.press(sheet(spark, rows), keys).collect()}
    assert got == {"1": ("pos", "", ""), "2": ("skip", "", ""), "3": ("skip", "", ""), "4": ("", "", "")}
    assert sheet(spark, rows).where(A.is_done()).count() == 3
    assert A.labelled_rows(sheet(spark, rows)).where(F.col("sentiment") == "skip").count() == 1
