import csv
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus as C
from corpusloom.sources import readers, sinks, video_api
from corpusloom.streaming import ingest


def comment(i, text="Бұл өте жақсы подкаст екен", video="v1"):
    return {"comment_id": i, "video_id": video, "channel_id": "secret", "author": "someone", "text": text, "like_count": 1, "published_at": "2024-01-01T00:00:00Z", "pulled_at": "2024-01-02T00:00:00Z"}


def write_lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) if r else "" for r in rows) + "\n", encoding="utf-8")


def test_raw_scan(spark, tmp_path):
    write_lines(tmp_path / "b.jsonl", [comment("1", "екінші"), comment("2"), None])
    write_lines(tmp_path / "a.jsonl", [comment("1", "бірінші @аты"), None, comment("3", None)])
    write_lines(tmp_path / "kids_gaming.jsonl", [comment("9")])
    raw = readers.read_raw(spark, str(tmp_path))
    assert "author" not in raw.columns and "channel_id" not in raw.columns
    rows = {r.comment_id: r for r in C.clean_text(C.first_by(raw, "comment_id")).collect()}
    assert set(rows) == {"1", "2", "3"} and rows["1"].text == "бірінші <USER>" and rows["1"].source_file == "a.jsonl" and rows["3"].text == ""
    assert readers.read_raw(spark, str(tmp_path), include_rejected=True).count() == 5
    assert readers.read_raw(spark, str(tmp_path), exclude=("b.jsonl",)).count() == 2
    scan = raw.select("comment_id")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in scan.split("ReadSchema")[1]


def test_corpus_round_trip(spark, tmp_path):
    write_lines(tmp_path / "a.jsonl", [comment("1"), comment("2", "Ал эмне кылат болот силер"), comment("3", "salem alem bugin")])
    done = C.build_corpus(readers.read_raw(spark, f"{tmp_path}/a.jsonl"))
    sinks.write_corpus(done, f"{tmp_path}/out")
    clean = readers.read_clean(spark, f"{tmp_path}/out/pool=clean")
    assert [r.comment_id for r in clean.collect()] == ["1"]
    assert readers.read_clean(spark, f"{tmp_path}/out/pool=romanized", ("text",)).columns == ["text"]
    assert [r.language for r in spark.read.json(f"{tmp_path}/out/pool=otherlang").collect()] == ["ky"]


def test_csv_edges(spark, tmp_path):
    with open(tmp_path / "sheet_01.csv", "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(["comment_id", "text", "sentiment", "density", "base_lang", "notes"])
        w.writerows([["1", 'a, "b"\nc', "pos", "", "kk", ""], ["", "x", "", "", "", ""], ["1", "later", "neg", "", "", ""]])
    (tmp_path / "manifest.csv").write_text("comment_id\n1\n")
    rows = readers.read_sheets(spark, f"{tmp_path}/sheet_*.csv", check=True).orderBy("line").collect()
    assert rows[0].text == 'a, "b"\nc' and rows[0].density == "" and rows[0].file == "sheet_01" and [r.line for r in rows] == [2, 3, 4]
    assert readers.read_batch(spark, f"{tmp_path}/sheet_01.csv").count() == 2
    assert [r.text for r in readers.read_sheet_last(spark, f"{tmp_path}/sheet_01.csv").collect()] == ["later"]
    (tmp_path / "odd.csv").write_text("comment_id,text\n1,t\n")
    with pytest.raises(ValueError, match="sentiment"):
        readers.read_sheets(spark, f"{tmp_path}/odd.csv", check=True)


def test_labelled_and_sources(spark, tmp_path):
    (tmp_path / "labelled.csv").write_text("comment_id,text,n_tokens,density_eligible\n1,t,7,True\n2,t,x,False\n")
    rows = readers.read_labelled(spark, f"{tmp_path}/labelled.csv").orderBy("comment_id").collect()
    assert [(r.n_tokens, r.density_eligible, r["sample"]) for r in rows] == [(7, True, ""), (None, False, "")]
    (tmp_path / "sources.csv").write_text("name,search_query,channel_id,priority,category,measured_mixed_pct,verified,note\na,q,UC1,1,c,,yes,\nb,q,,,c,,no,\nc,q,UC3,0,c,,,REJECTED twice\nd,q, ,two,c,,Yes,\n")
    p = f"{tmp_path}/sources.csv"
    assert [r.name for r in readers.channel_sources(spark, p).collect()] == ["a", "c"]
    assert [r.name for r in readers.searchable_sources(spark, p).collect()] == ["a"]
    assert [r.name for r in readers.searchable_sources(spark, p, 9).collect()] == ["a", "b", "d"]
    assert [r.name for r in readers.unverified_sources(spark, p).collect()] == ["b", "c"]
    (tmp_path / "videos.csv").write_text("video_id,source_name,comment_count,pulled\n v1 ,s,5,\nv2,s,6,YES\n,s,1,\n")
    assert [r.video_id for r in readers.videos_to_pull(spark, f"{tmp_path}/videos.csv").collect()] == ["v1"]


def test_append_resumes(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, "t") for i in ids], "comment_id string, text string")
    path = f"{tmp_path}/target"
    sinks.append_new(spark, rows("1", "1", "2"), path)
    sinks.append_new(spark, rows("2", "3"), path)
    assert sorted(r.comment_id for r in spark.read.json(path).collect()) == ["1", "2", "3"]


def test_frozen_and_folds(spark, tmp_path):
    from corpusloom.operators import folds as FO

    made = FO.make_folds(spark.createDataFrame([(str(i), "a|b") for i in range(20)], "comment_id string, stratum string"))
    sinks.write_once(FO.nested(made, 5), f"{tmp_path}/folds")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_once(FO.nested(made, 5), f"{tmp_path}/folds")
    assert FO.flat(readers.read_folds(spark, f"{tmp_path}/folds")).count() == 20
    sinks.write_sheets(spark.createDataFrame([("b_01", "1", 'x, "y"')], "batch string, comment_id string, text string"), f"{tmp_path}/sheets")
    assert readers.read_sheets(spark, f"{tmp_path}/sheets/batch=b_01").first().text == 'x, "y"'


def test_large_batch_is_several_files(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") < 3990, "big").otherwise("small").alias("batch"), F.col("id").cast("string").alias("comment_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k")
    try:
        sinks.write_sheets(rows, f"{tmp_path}/s")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {b: list((tmp_path / "s" / f"batch={b}").glob("*.csv")) for b in ("big", "small")}
    assert len(files["big"]) > 3 and len(files["small"]) == 1 and max(f.stat().st_size for f in files["big"]) < 300_000
    assert readers.read_batch(spark, f"{tmp_path}/s/batch=big").select("comment_id").distinct().count() == 3990


def test_prompt_files(spark, tmp_path):
    prompted = spark.createDataFrame([("prompt_01", 1, ["7"], "body\nline")], "prompt string, n long, ids array<string>, body string")
    sinks.write_prompts(prompted, f"{tmp_path}/p")
    assert readers.read_prompt_index(spark, f"{tmp_path}/p/index").first().ids == ["7"]
    (tmp_path / "reply_01.json").write_text('[{"id": "7"}]\n')
    assert readers.read_replies(spark, f"{tmp_path}/reply_01.json").first().reply == "reply_01"


def test_prompt_index_keeps_every_entry(spark, tmp_path):
    rows = [(f"prompt_{i:02d}", 1, [str(i)], f"body {i}\nline") for i in range(7)]
    sinks.write_prompts(spark.createDataFrame(rows, "prompt string, n long, ids array<string>, body string").coalesce(1), f"{tmp_path}/p")
    assert sorted(r.ids[0] for r in readers.read_prompt_index(spark, f"{tmp_path}/p/index").collect()) == [str(i) for i in range(7)]
    assert {r.prompt: r.body for r in readers.read_prompts(spark, f"{tmp_path}/p/prompts").collect()} == {r[0]: r[3] + "\n" for r in rows}
    entries = [{"prompt": r[0], "n": r[1], "ids": r[2]} for r in rows]
    for name, text in (("indented", json.dumps(entries, indent=1)), ("flat", json.dumps(entries)), ("empty", "")):
        (tmp_path / name).write_text(text)
        assert readers.read_prompt_index(spark, f"{tmp_path}/{name}").count() == (7 if text else 0)


def test_reply_of_many_lines_is_one_row(spark, tmp_path):
    (tmp_path / "reply_01.json").write_text('[\n{"id": "7"}\n]\n')
    assert [r.raw for r in readers.read_replies(spark, f"{tmp_path}/reply_01.json").collect()] == ['[\n{"id": "7"}\n]\n']


def test_prompt_query_writes_whole_texts(spark, monkeypatch):
    from corpusloom.plans import records

    bodies = []
    monkeypatch.setattr(records.sinks, "write_prompts", lambda prompted, folder, own=sinks.write_prompts: (bodies.extend(r.body for r in prompted.collect()), own(prompted, folder))[1])
    got = records.prompt_index(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(bodies) > 0 and sum(r.n for r in got) == sum(len(r.ids.split(",")) for r in got)
    assert not any('"text": "text"' in b for b in bodies) and max(map(len, bodies)) > 10_000


def make_api():
    # Nested, so that it travels to the workers by value.
    def fake_api(method, params):
        if method == "commentThreads":
            if params["videoId"] == "gone":
                raise OSError("disabled")
            page = int(params.get("pageToken", 0))
            items = [{"snippet": {"topLevelComment": {"id": f"{params['videoId']}-{page}-{i}", "snippet": {"textOriginal": "t"}}}} for i in range(min(2, params["maxResults"]))]
            return {"items": items, "nextPageToken": str(page + 1) if page < 2 else None}
        if method == "channels":
            return {"items": [{"contentDetails": {"relatedPlaylists": {"uploads": "U"}}}]} if params["id"] == "UC" else {}
        if method == "playlistItems":
            return {"items": [{"contentDetails": {"videoId": f"v{i}"}} for i in range(3)]}
        if method == "search":
            return {"items": [{"id": {"videoId": "v"}, "snippet": {"title": "t", "channelTitle": "c", "publishedAt": "p", "channelId": "UC"}}]}
        return {"items": [{"id": v, "statistics": {"commentCount": "300"} if v == "v0" else {}} for v in params["id"].split(",")]}

    return fake_api


def test_comment_api(spark):
    fake_api = make_api()
    rows = video_api.read_comments(spark, fake_api, ["a", "gone", "b"], most=5).collect()
    assert len(rows) == 10 and {r.video_id for r in rows} == {"a", "b"} and rows[0].like_count == 0
    assert video_api.channel_videos(fake_api, "UC", 2) == ["v0", "v1"] and video_api.channel_videos(fake_api, "no", 2) == []
    assert video_api.search_videos(fake_api, "q", 5)[0]["video_id"] == "v" and video_api.resolve_channel(fake_api, "q") == "UC"
    stats = spark.createDataFrame(video_api.video_statistics(fake_api, [f"v{i}" for i in range(60)]), "video_id string, comment_count long, view_count long")
    videos = spark.createDataFrame([("v0",), ("v1",), ("v0",), ("zz",)], "video_id string")
    assert [(r.video_id, r.comment_count) for r in video_api.with_statistics(videos, stats).collect()] == [("v0", 300)]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    write_lines(tmp_path / "raw" / "a.jsonl", [comment("1"), comment("1"), comment("2", "да")])
    routed = ingest.routed_stream(ingest.raw_stream(spark, f"{tmp_path}/raw"))
    for round_ in (1, 2):
        ingest.run_stream(routed, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        if round_ == 1:
            write_lines(tmp_path / "raw" / "b.jsonl", [comment("2", "да"), comment("3")])
    got = {r.comment_id: (r.status, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"1": ("ok", ""), "2": ("drop", "too_few_tokens"), "3": ("ok", "")}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    assert ingest.bucket_stream(routed).isStreaming
