"""SQL functions, wrapping, replacing tables, cached vectors, pilot passes and pools."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import annotation as A
from corpusloom.operators import density as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import features as FE
from corpusloom.operators import sampling as S
from corpusloom.sources import sinks, video_api


def test_sql_functions(spark):
    T.register(spark)
    texts = ["Сәлем @user.name  см. https://t.me/x?y=1\n да!", "abc d e", "123", "Керемет видео, РАХМЕТ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    pairs = {"anonymize(t)": T.anonymize(c), "norm_key(t)": T.norm_key(c), "token_key(t)": T.token_key(c), "script_of(t)": T.script_of(c)}
    for sql, column in pairs.items():
        for a, b in df.select(F.expr(sql), column).collect():
            assert a == b, sql
    assert spark.sql("SELECT density_bucket(2, 3), density_bucket(0, 0), density_bucket(1, 9)").first()[:] == ("med", "unknown", "low")


def test_wrap(spark):
    row = spark.createDataFrame([("one two  three four", ""), ("averyverylongword b", " ")], "a string, b string").select(T.wrap(F.col("a"), 9).alias("a"), T.wrap(F.col("b"), 9).alias("b")).collect()
    assert [list(r.a) for r in row] == [["one two", "three", "four"], ["averyverylongword", "b"]] and all(list(r.b) == [] for r in row)


def test_replace_what_is_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(5).write.parquet(path)
    sinks.replace(spark.read.parquet(path).where("id > 2"), path)
    sinks.replace(spark.read.parquet(path).withColumn("x", F.lit(1)), path)
    assert spark.read.parquet(path).columns == ["id", "x"] and spark.read.parquet(path).count() == 2
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_cached_vectors(spark, tmp_path):
    docs = spark.createDataFrame([("алма бала дала",), ("алма бала",)], "text string")
    first = FE.cached_vectors(docs, f"{tmp_path}/v", dim=3, min_count=1, epochs=1).collect()
    assert sorted(FE.cached_vectors(docs.limit(0), f"{tmp_path}/v").collect()) == sorted(first)


def test_pilot_passes_and_pool(spark):
    batch = spark.createDataFrame([(str(i),) for i in range(30)], "comment_id string")
    rows = S.pilot_passes(batch).collect()
    assert sorted(r.pass1 for r in rows) == sorted(r.pass2 for r in rows) == list(range(1, 31)) and any(r.pass1 != r.pass2 for r in rows)
    lexicon = spark.createDataFrame([("қала", "kk", True), ("город", "ru", True)], "word string, lang string, confident boolean")
    model = D.DensityModel(lexicon, D.char_model(lexicon.selectExpr("word", "lang", "cast(5 as bigint) as n")), D.stripped_forms(lexicon))
    pool = S.strata_pool(spark.createDataFrame([(1, "қала город"), (2, "")], "seq long, text string"), model)
    assert {r.seq: r.density for r in pool.collect()} == {1: "high", 2: "mono"}


def test_small_reports(spark):
    pairs = spark.createDataFrame([("2", "a", "b"), ("1", "a", "c"), ("3", "a", "a")], "comment_id string, va string, vb string")
    sheet = spark.createDataFrame([("1", "x" * 90)], "comment_id string, text string")
    got = E.disagreements(pairs, sheet).collect()
    assert [r.comment_id for r in got] == ["1", "2"] and len(got[0].text) == 70
    assert video_api.comments_available(spark.createDataFrame([(3,), (4,)], "comment_count long")).first().comments == 7
    rows = spark.createDataFrame([("b1", 1, "1", "t", ""), ("b2", 1, "2", "t", "")], "file string, line long, comment_id string, text string, sentiment string")
    assert [list(r.ids) for r in A.prompts(rows, "", only=("b2",)).collect()] == [["2"]]
