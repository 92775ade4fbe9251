"""Queries over files: the driver's tables are written in the corpus's file formats to the shared folder and read back, and the
annotation steps run over what was read.  Each has its DuckDB form over the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import annotation as A
from corpusloom.operators import corpus as C
from corpusloom.operators import evaluation as E
from corpusloom.operators import features as FE
from corpusloom.operators import folds as FO
from corpusloom.operators import prompts as P
from corpusloom.operators import sampling as S
from corpusloom.sources import readers, sinks, video_api
from corpusloom.storage import shared_path

from . import oracle as O
from . import roles as R
from .registry import _FOLDS, PAIR, query, six

_N = "CAST({} AS BIGINT)".format


def _folder(spark, name: str) -> str:
    return shared_path(spark, name)


def _raw_lines(spark, sf_dir):
    d = R.cleaned(spark, sf_dir)
    return d.select(F.col("comment_id").cast("string").alias("comment_id"), "video_id", F.lit("ch").alias("channel_id"), F.lit("someone").alias("author"), "text", (F.col("seq") % 5).alias("like_count"), F.lit("2024-01-01T00:00:00Z").alias("published_at"), F.lit("now").alias("pulled_at"))


@query(O.sql(O.TXT, f"SELECT CAST(seq AS VARCHAR) AS comment_id, video_id, md5(text) AS text_md5, {_N('seq % 5')} AS like_count, false AS has_author FROM txt"))
def raw_scan(spark, sf_dir):
    """Raw JSON lines written and scanned: every row once, without author, channel and time of pull."""
    path = _folder(spark, "raw")
    _raw_lines(spark, sf_dir).write.json(path)
    rows = readers.read_raw(spark, path)
    return rows.select("comment_id", "video_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "like_count", F.lit("author" in rows.columns).alias("has_author"))


@query(O.sql(O.TXT, f"SELECT CAST(seq AS VARCHAR) AS comment_id, {_N('seq % 5')} AS like_count FROM txt"))
def resumed_pull(spark, sf_dir):
    """A pull interrupted half-way and run again twice writes every comment once."""
    path = _folder(spark, "pulled")
    rows = _raw_lines(spark, sf_dir).drop("text")
    sinks.append_new(spark, rows.where(F.col("like_count") < 2), path)
    for _ in range(2):
        sinks.append_new(spark, rows.unionByName(rows), path)
    return spark.read.schema("comment_id string, like_count long").json(path)


def _pools(spark, sf_dir):
    rows = R.screened(spark, sf_dir)
    pool = F.when(F.col("seq") % 7 == 0, None).when(F.col("seq") % 5 == 0, "romanized").otherwise("clean")
    n = T.n_tokens(F.col("text"), PAIR)
    return rows.select(F.col("comment_id").cast("string").alias("comment_id"), "video_id", "source_file", "text", n.alias("n_tokens"), "screen_a", "screen_b", "screen_bucket", (n >= 5).alias("density_eligible"), F.lit(None).cast("string").alias("language"), pool.alias("pool"))


@query(O.sql(O.screened(), f"SELECT CAST(seq AS VARCHAR) AS comment_id, md5(text) AS text_md5, {_N('len(' + O.tokens('text') + ')')} AS n_tokens, screen_bucket, len({O.tokens('text')}) >= 5 AS density_eligible FROM screened WHERE seq % 7 <> 0 AND seq % 5 <> 0"))
def clean_scan(spark, sf_dir):
    """The pools written in one pass, and the clean one scanned."""
    path = _folder(spark, "pools")
    sinks.write_corpus(_pools(spark, sf_dir), path)
    rows = readers.read_clean(spark, f"{path}/pool=clean")
    return rows.select("comment_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("n_tokens").cast("long").alias("n_tokens"), "screen_bucket", "density_eligible")


# --- sheets, manifests, merging -----------------------------------------------------------------------


def _sheets(spark, sf_dir):
    """Label sheets with texts, in which comments of even ids stand twice, the second time with other labels."""
    s = R.sheets(spark, sf_dir).join(R.cleaned(spark, sf_dir).select(F.col("seq").alias("line"), "text"), "line")
    twice = s.where(F.col("line") % 2 == 0).withColumns({"file": F.concat(F.lit("z_"), "file"), "sentiment": F.lit("neu")})
    return s.unionByName(twice)


_TWICE = f"""{O.SHEETS},
both_ AS (SELECT *, false AS again FROM sheets UNION ALL SELECT 'z_' || file, line, comment_id, 'neu', density, base_lang, true FROM sheets WHERE line % 2 = 0)"""


@query(O.sql(O.SHEETS + "," + O.TXT, "SELECT comment_id, 'b_' || CAST(line % 3 AS VARCHAR) AS batch, md5(text) AS text_md5, '' AS sentiment, '' AS density, '' AS base_lang, '' AS notes FROM sheets JOIN txt ON seq = line"))
def sheet_files(spark, sf_dir):
    """Blank sheets written for each batch and read with their columns checked."""
    path = _folder(spark, "sheets")
    rows = R.sheets(spark, sf_dir).join(R.cleaned(spark, sf_dir).select(F.col("seq").alias("line"), "text"), "line")
    sinks.write_sheets(rows.select(F.concat(F.lit("b_"), (F.col("line") % 3).cast("string")).alias("batch"), "comment_id", "text"), path)
    found = [readers.read_batch(spark, f"{path}/batch=b_{k}").withColumn("batch", F.lit(f"b_{k}")) for k in range(3)]
    rows = A.require_columns(found[0].unionByName(found[1]).unionByName(found[2]))
    return rows.select("comment_id", "batch", F.md5(F.col("text").cast("binary")).alias("text_md5"), "sentiment", "density", "base_lang", "notes")


@query(O.sql(_TWICE, "SELECT comment_id, arg_max(sentiment, file) AS sentiment FROM (SELECT * FROM both_ WHERE NOT again OR line % 2 = 0) GROUP BY comment_id"))
def sheet_last_row(spark, sf_dir):
    """Of rows that repeat an id the last one counts."""
    s = _sheets(spark, sf_dir)
    rows = s.withColumn("line", F.when(F.col("file").startswith("z_"), F.col("line") + 1_000_000_000).otherwise(F.col("line")))
    return E.last_rows(rows.withColumn("file", F.lit("one"))).select("comment_id", T.cell(F.col("sentiment")).alias("sentiment"))


def _manifest(spark, sf_dir):
    """Every labelled comment as a draw; those divisible by 3 as a retest before and after it too, those by 5 drawn again later."""
    s = R.sheets(spark, sf_dir).select("comment_id", F.col("line").alias("k"))
    draw = s.select("comment_id", F.lit("natural").alias("sample"), F.lit("0.1").alias("inclusion_prob"), (F.col("k") * 10 + 5).alias("line"))
    retests = [s.where("k % 3 = 0").select("comment_id", F.lit("retest").alias("sample"), F.lit("").alias("inclusion_prob"), (F.col("k") * 10 + d).alias("line")) for d in (1, 9)]
    later = s.where("k % 5 = 0").select("comment_id", F.lit("enriched").alias("sample"), F.lit("0.2").alias("inclusion_prob"), (F.col("k") * 10 + 7).alias("line"))
    return draw.unionByName(retests[0]).unionByName(retests[1]).unionByName(later)


_SAMPLE = "CASE WHEN line % 5 = 0 THEN 'enriched' ELSE 'natural' END AS sample, CASE WHEN line % 5 = 0 THEN '0.2' ELSE '0.1' END AS inclusion_prob"


@query(O.sql(O.SHEETS, f"SELECT comment_id, {_SAMPLE} FROM sheets"))
def manifest_precedence(spark, sf_dir):
    return A.manifest_index(_manifest(spark, sf_dir)).select("comment_id", "sample", "inclusion_prob")


_OUTCOME = f"""{_TWICE},
judged AS (SELECT *, CASE WHEN sentiment = '' THEN 'blank' WHEN sentiment = 'skip' THEN 'skipped' WHEN sentiment NOT IN ('pos', 'neg', 'neu') OR density NOT IN {O.words_in(A.DENSITIES)} OR base_lang NOT IN {O.words_in(A.LANGUAGES)} THEN 'invalid' WHEN line % 9 = 0 THEN 'unknown' END AS o FROM both_),
merged AS (SELECT *, coalesce(o, CASE WHEN row_number() OVER (PARTITION BY comment_id, o IS NULL ORDER BY file, line) = 1 THEN 'labelled' ELSE 'repeated' END) AS outcome FROM judged)"""


def _merged(spark, sf_dir):
    d = R.table(spark, sf_dir, "documents").where(F.col("doc_id") % 9 != 0)
    clean = d.select(F.col("doc_id").cast("string").alias("comment_id"), "text", F.col("source").alias("video_id"), F.lit(0).alias("n_tokens"), (F.col("doc_id") % 2 == 0).alias("density_eligible"), F.lit("mono").alias("screen_bucket"), F.lit(2).alias("seq"))
    stale = clean.withColumns({"seq": F.lit(1), "density_eligible": F.lit(True), "screen_bucket": F.lit("old")})
    return A.merge(_sheets(spark, sf_dir), clean.unionByName(stale), _manifest(spark, sf_dir))


@query(O.sql(_OUTCOME, f"SELECT comment_id, file, line, outcome, sentiment, CASE WHEN line % 9 <> 0 THEN 'mono' END AS screen_bucket, {_SAMPLE} FROM merged"))
def merge_repeats(spark, sf_dir):
    """Merging under a manifest with retests and a clean corpus that repeats ids: one row for each sheet row, first labels win."""
    return _merged(spark, sf_dir).select("comment_id", "file", "line", "outcome", "sentiment", "screen_bucket", "sample", "inclusion_prob")


@query(
    O.sql(
        _OUTCOME,
        "SELECT 'outcome' AS axis, outcome AS value, count(*) AS n FROM merged GROUP BY 2 UNION ALL SELECT 'sentiment', sentiment, count(*) FROM merged WHERE outcome = 'labelled' GROUP BY 2 UNION ALL SELECT 'density', density, count(*) FROM merged WHERE outcome = 'labelled' GROUP BY 2"
        " UNION ALL SELECT 'base_lang', base_lang, count(*) FROM merged WHERE outcome = 'labelled' GROUP BY 2 UNION ALL SELECT 'eligible', 'density', count(*) FROM merged WHERE outcome = 'labelled' AND line % 2 = 0 HAVING count(*) > 0",
    )
)
def merge_summary(spark, sf_dir):
    return A.merge_summary(_merged(spark, sf_dir))


@query(O.sql(_TWICE, "SELECT 'warning' AS level, file, line FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY file, line) AS k FROM both_) WHERE k > 1"))
def repeat_warnings(spark, sf_dir):
    found = A.findings(_sheets(spark, sf_dir))
    return found.where("message = 'comment_id appears twice across batches'").select("level", "file", "line")


@query(O.sql(O.SHEETS, "SELECT comment_id, sentiment = 'skip' OR (sentiment <> '' AND density <> '' AND base_lang <> '') AS done FROM sheets"))
def done_rows(spark, sf_dir):
    return R.sheets(spark, sf_dir).select("comment_id", A.is_done().alias("done"))


_PRESSED = "CASE line % 4 WHEN 0 THEN 'skip' WHEN 1 THEN '' ELSE sentiment END"


@query(O.sql(O.SHEETS, f"SELECT comment_id, {_PRESSED} AS sentiment, CASE WHEN line % 4 IN (0, 1) THEN '' WHEN line % 4 = 2 AND sentiment <> 'skip' THEN 'mono' ELSE density END AS density, CASE WHEN line % 4 IN (0, 1) THEN '' ELSE base_lang END AS base_lang FROM sheets"))
def pressed_keys(spark, sf_dir):
    """One key of the annotation interface on every row: skip, clear, a density, an unknown key."""
    s = R.sheets(spark, sf_dir).withColumns({c: T.cell(F.col(c)) for c in ("sentiment", "density", "base_lang")})
    key = F.element_at(F.array(*map(F.lit, ("0", "u", "q", "?"))), (F.col("line") % 4 + 1).cast("int"))
    return A.press(s, s.select("comment_id", key.alias("key"))).select("comment_id", "sentiment", "density", "base_lang")


@query(O.sql(O.SHEETS, "SELECT comment_id, CASE WHEN sentiment <> 'skip' AND line % 3 <> 0 THEN 'med' ELSE density END AS density, CASE WHEN sentiment <> 'skip' AND line % 3 <> 0 AND base_lang = '' THEN 'kk' ELSE base_lang END AS base_lang FROM sheets"))
def filled_sheet(spark, sf_dir):
    """Measured density written into sheets, which then replace what they were read from; empty measures and skipped rows stay."""
    from corpusloom.operators.density import fill_sheet

    path = _folder(spark, "filled")
    s = R.sheets(spark, sf_dir).withColumns({c: T.cell(F.col(c)) for c in ("sentiment", "density", "base_lang")})
    s.write.parquet(path)
    read = spark.read.parquet(path)
    measured = read.select("comment_id", F.when(F.col("line") % 3 == 0, "").otherwise("med").alias("density"), F.lit("kk").alias("base_lang"))
    sinks.replace(fill_sheet(read, measured), path)
    return spark.read.parquet(path).select("comment_id", "density", "base_lang")


# --- prompts and replies ------------------------------------------------------------------------------


def _replies(spark, sf_dir):
    """(replies, index): a reply of ten comments for each prompt, in a code fence, amid prose or bare, with faults at fixed places."""
    from corpusloom.storage import materialise

    s = R.sheets(spark, sf_dir).select("comment_id", F.col("line").alias("k"), F.floor(F.col("line") / 50).alias("p"))
    name = lambda kind: F.concat(F.lit(f"{kind}_"), F.col("p").cast("string")).alias(kind)
    sentiment = F.when(F.col("k") % 11 == 0, "bad").when(F.col("k") % 4 == 0, "skip").otherwise("POS ")
    answer = F.struct(F.col("comment_id").alias("id"), sentiment.alias("sentiment"), F.when(F.col("k") % 13 == 0, "zz").otherwise("ru").alias("base_lang"), F.when(F.col("k") % 6 == 0, "low").otherwise("high").alias("confidence"), F.lit("").alias("note"))
    first = F.struct(F.col("k").alias("k"), answer.alias("a"))
    got = s.where("k % 7 <> 0").groupBy("p").agg(F.transform(F.sort_array(F.collect_list(first)), lambda x: x.a).alias("a"))
    raw = F.to_json("a")
    form = F.when(F.col("p") % 3 == 0, F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).when(F.col("p") % 3 == 1, F.concat(F.lit("Here it is: "), raw, F.lit(" done"))).otherwise(raw)
    replies = got.select(name("reply"), F.when(F.col("p") % 5 == 4, "no array").otherwise(form).alias("raw"))
    index = s.groupBy("p").agg(F.sort_array(F.collect_list("comment_id")).alias("ids"), F.count("*").cast("int").alias("n")).select(name("prompt"), "n", "ids")
    path = _folder(spark, "prompt-index")
    index.write.json(path)
    return materialise(replies, "replies"), spark.read.schema("prompt string, n int, ids array<string>").json(path)


_ANSWERS = f"""{O.SHEETS},
asked AS (SELECT comment_id, line AS k, line // 50 AS p FROM sheets),
answers AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'bad' WHEN k % 4 = 0 THEN 'skip' ELSE 'pos' END AS sentiment, CASE WHEN k % 13 = 0 THEN 'zz' ELSE 'ru' END AS lang FROM asked WHERE k % 7 <> 0 AND p % 5 <> 4),
accepted AS (SELECT comment_id AS id, k, p, sentiment, CASE WHEN sentiment = 'skip' THEN '' ELSE lang END AS base_lang, CASE WHEN k % 6 = 0 THEN 'low' ELSE 'high' END AS confidence FROM answers WHERE sentiment <> 'bad' AND (sentiment = 'skip' OR lang = 'ru'))"""


@query(O.sql(_ANSWERS, "SELECT id, sentiment, base_lang, confidence FROM accepted"))
def reply_accepted(spark, sf_dir):
    return A.ingest(*_replies(spark, sf_dir))[0].select("id", "sentiment", "base_lang", "confidence")


@query(
    O.sql(
        _ANSWERS,
        "SELECT 'reply_' || CAST(p AS VARCHAR) AS reply, left(comment_id, 12) || CASE WHEN sentiment = 'bad' THEN ': sentiment ''bad''' ELSE ': base_lang ''zz''' END AS problem FROM answers WHERE sentiment = 'bad' OR (sentiment <> 'skip' AND lang = 'zz')"
        " UNION ALL SELECT 'reply_' || CAST(p AS VARCHAR), 'no JSON array found' FROM asked WHERE p % 5 = 4 GROUP BY p HAVING count(*) FILTER (k % 7 <> 0) > 0"
        " UNION ALL SELECT 'reply_' || CAST(p AS VARCHAR), CAST(count(*) - coalesce(g, 0) AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) || ' comments unanswered' FROM asked LEFT JOIN (SELECT p, count(*) AS g FROM accepted GROUP BY p) USING (p) WHERE p % 5 <> 4 GROUP BY p, g HAVING count(*) > coalesce(g, 0) AND count(*) FILTER (k % 7 <> 0) > 0",
    )
)
def reply_problems(spark, sf_dir):
    return A.ingest(*_replies(spark, sf_dir))[1]


@query(O.sql(_ANSWERS, "SELECT 'confidence' AS axis, confidence AS value, count(*) AS n FROM accepted GROUP BY 2 UNION ALL SELECT 'sentiment', sentiment, count(*) FROM accepted GROUP BY 2"))
def reply_summary(spark, sf_dir):
    return A.answer_summary(A.ingest(*_replies(spark, sf_dir))[0])


@query(O.sql(_ANSWERS, "SELECT s.comment_id, CASE WHEN s.sentiment = '' AND a.id IS NOT NULL THEN a.sentiment ELSE s.sentiment END AS sentiment, CASE WHEN s.sentiment = '' AND a.id IS NOT NULL THEN a.base_lang ELSE s.base_lang END AS base_lang, s.density FROM sheets s LEFT JOIN accepted a ON a.id = s.comment_id"))
def reply_applied(spark, sf_dir):
    s = R.sheets(spark, sf_dir).withColumns({c: T.cell(F.col(c)) for c in ("sentiment", "density", "base_lang")})
    return A.apply_answers(s, A.ingest(*_replies(spark, sf_dir))[0]).select("comment_id", "sentiment", "base_lang", "density")


_CHECKED = f"""{_ANSWERS},
high AS (SELECT *, row_number() OVER (ORDER BY {O.shuffled('id')}, id) AS r, count(*) OVER () AS m FROM accepted WHERE confidence = 'high'),
checked AS (SELECT id, sentiment, base_lang, confidence FROM accepted WHERE confidence = 'low' UNION ALL SELECT id, sentiment, base_lang, confidence FROM high WHERE r <= round_even(m * 0.12::DOUBLE, 0))"""


@query(O.sql(_CHECKED, "SELECT id, confidence FROM checked"))
def spot_check(spark, sf_dir):
    return S.spot_check(A.ingest(*_replies(spark, sf_dir))[0]).select("id", "confidence")


@query(O.sql(_CHECKED + "," + O.TXT, "SELECT id AS comment_id, md5(CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN text ELSE '' END) AS text_md5, sentiment AS llm_sentiment, base_lang AS llm_base_lang, confidence AS llm_confidence, '' AS llm_note, '' AS human_sentiment, '' AS human_base_lang, '' AS human_note FROM checked JOIN txt ON seq = CAST(id AS BIGINT)"))
def audit_queue(spark, sf_dir):
    """The queue for a human, with the text where a sheet has it."""
    sheets = R.cleaned(spark, sf_dir).where("seq % 2 = 0").select(F.col("seq").cast("string").alias("comment_id"), "text")
    queue = A.audit_queue(S.spot_check(A.ingest(*_replies(spark, sf_dir))[0]), sheets)
    return queue.withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


@query(O.sql(_TWICE, "SELECT 'prompt_' || CASE WHEN k < 100 THEN lpad(CAST(k AS VARCHAR), 2, '0') ELSE CAST(k AS VARCHAR) END AS prompt, count(*) AS n, string_agg(comment_id, ',' ORDER BY file, line) AS ids FROM (SELECT *, (row_number() OVER (ORDER BY file, line) - 1) // 40 + 1 AS k FROM sheets WHERE sentiment = '') GROUP BY k"))
def prompt_index(spark, sf_dir):
    """Prompts over the texts of the rows without a label, written with their index; both are read, and comments counted in the prompts themselves."""
    path = _folder(spark, "prompts")
    s = C.clean_text(R.sheets(spark, sf_dir, F.col("text")))
    sinks.write_prompts(A.prompts(s, P.INSTRUCTIONS), path)
    n = F.regexp_count("body", F.lit(r'(?m)^\{"id": "')).cast("long")
    index = readers.read_prompt_index(spark, f"{path}/index").select("prompt", F.array_join("ids", ",").alias("ids"))
    return index.join(readers.read_prompts(spark, f"{path}/prompts").select("prompt", n.alias("n")), "prompt").select("prompt", "n", "ids")


# --- labelled corpus, predictions, folds --------------------------------------------------------------


@query(O.sql(O.SHEETS + "," + O.TXT, f"SELECT comment_id, md5(text) AS text_md5, sentiment, {_N('len(' + O.tokens('text') + ')')} AS n_tokens, line % 2 = 0 AS density_eligible, '' AS notes FROM sheets JOIN txt ON seq = line"))
def labelled_file(spark, sf_dir):
    """The labelled corpus as CSV, with quotes and commas in cells, written and read."""
    path = _folder(spark, "labelled")
    rows = R.sheets(spark, sf_dir).join(R.cleaned(spark, sf_dir).select(F.col("seq").alias("line"), "text"), "line")
    sinks.write_csv(rows.select("comment_id", "text", T.cell(F.col("sentiment")).alias("sentiment"), "density", "base_lang", "notes", F.col("file").alias("video_id"), T.n_tokens(F.col("text"), PAIR).alias("n_tokens"), (F.col("line") % 2 == 0).alias("density_eligible")), path)
    got = readers.read_labelled(spark, path)
    return got.select("comment_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "sentiment", F.col("n_tokens").cast("long").alias("n_tokens"), "density_eligible", "notes")


@query(O.sql(O.PREDICTIONS, "SELECT CAST(comment_id AS VARCHAR) AS comment_id, representation, gold, pred, n_tokens, CAST(1 AS BIGINT) AS fold FROM preds"))
def prediction_file(spark, sf_dir):
    path = _folder(spark, "predictions")
    sinks.write_csv(R.predictions(spark, sf_dir), path)
    got = readers.read_predictions(spark, path)
    return got.select("comment_id", "representation", "gold", "pred", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("fold").cast("long").alias("fold"))


@query(O.sql(_FOLDS, "SELECT CAST(comment_id AS VARCHAR) AS comment_id, split, fold FROM folds WHERE comment_id % 3 <> 0"))
def frozen_folds(spark, sf_dir):
    """Folds frozen once, read back and joined with labelled rows; ids without a row are dropped."""
    path = _folder(spark, "folds")
    rows = R.labelled(spark, sf_dir)
    sinks.write_once(FO.nested(FO.make_folds(rows).withColumn("comment_id", F.col("comment_id").cast("string")), 5), path)
    known = rows.where(F.col("comment_id") % 3 != 0).select(F.col("comment_id").cast("string").alias("comment_id"))
    return FO.flat(readers.read_folds(spark, path)).join(known, "comment_id").select("comment_id", "split", "fold")


@query(O.sql(_FOLDS, "SELECT comment_id, fold + 1 AS fold, split_part(stratum, '|', 1) AS gold, 'tfidf_word' AS representation, true AS known_label FROM folds WHERE fold IS NOT NULL"))
def cv_rows(spark, sf_dir):
    """Cross-validation gives each row of a fold one prediction, by a model that its own fold took no part in; the labels are those of training."""
    from corpusloom.operators import models as M

    rows = M.settled(FO.make_folds(R.labelled(spark, sf_dir)))
    got = M.cross_validate(rows, "tfidf_word", lambda: FE.tfidf_word(PAIR), "logreg")
    return got.select("comment_id", F.col("fold").cast("long").alias("fold"), "gold", "representation", F.col("pred").isin("pos", "neg").alias("known_label"))


@query(O.sql(O.SHEETS + "," + O.screened(), "SELECT comment_id, density AS va, screen_bucket AS vb FROM sheets JOIN screened ON seq = line WHERE density <> '' AND density <> screen_bucket ORDER BY comment_id LIMIT 40"))
def disagreements(spark, sf_dir):
    """The first 40 disagreements of label and screen: a report's head."""
    a = R.sheets(spark, sf_dir)
    b = R.screened(spark, sf_dir).select(F.col("comment_id").cast("string").alias("comment_id"), F.col("screen_bucket").alias("density"), "text")
    return E.disagreements(E.label_pairs(a, b, "density"), b).select("comment_id", "va", "vb")


@query(O.sql(O.measured() + ",\n" + O.SHEETS, "SELECT count(*) AS n, count(*) FILTER (m.density = s.density) AS agreed, count(*) FILTER (m.density IN ('low', 'med', 'high') AND s.density IN ('low', 'med', 'high')) AS tp FROM sheets s JOIN measured m ON m.seq = s.line WHERE sentiment NOT IN ('', 'skip')"))
def density_vs_label(spark, sf_dir):
    """Measured density against the label."""
    from corpusloom.operators import density as D

    from .registry import _model

    rows = A.labelled_rows(R.sheets(spark, sf_dir)).where("sentiment <> 'skip'")
    measured = D.measure(R.cleaned(spark, sf_dir), _model(spark, sf_dir)).select("seq", F.col("density").alias("measured"))
    return E.detector_scores(rows.join(measured, F.col("line") == F.col("seq")), "measured", "density").select("n", "agreed", "tp")


# --- sources and videos -------------------------------------------------------------------------------


def _sources(spark, sf_dir) -> str:
    path = _folder(spark, "sources")
    s = R.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    sinks.write_csv(
        s.select(
            F.col("s_name").alias("name"), F.lit('a "quoted", query').alias("search_query"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("channel_id"),
            F.when(k % 7 == 0, "").otherwise((k % 4).cast("string")).alias("priority"), F.lit("talk").alias("category"), F.lit("").alias("measured_mixed_pct"), F.when(k % 2 == 0, "YES").otherwise("no").alias("verified"),
            F.when(k % 5 == 0, "REJECTED: kids").otherwise("ok").alias("note"),
        ),
        path,
    )
    return path


@query("SELECT 'channel' AS kind, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'searchable', s_name FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 4 <= 2 UNION ALL SELECT 'unverified', s_name FROM supplier WHERE s_suppkey % 2 <> 0")
def source_lists(spark, sf_dir):
    """Sources by channel, by priority and by verification."""
    path = _sources(spark, sf_dir)
    lists = {"channel": readers.channel_sources(spark, path), "searchable": readers.searchable_sources(spark, path), "unverified": readers.unverified_sources(spark, path)}
    parts = [rows.select(F.lit(kind).alias("kind"), "name") for kind, rows in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_COUNTS = "counts AS (SELECT source AS video_id, count(*) AS c FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1), videos AS (SELECT DISTINCT source AS video_id FROM documents)"


def _videos(spark, sf_dir):
    d = R.table(spark, sf_dir, "documents").select(F.col("source").alias("video_id"), "doc_id")
    stats = d.where("doc_id % 3 <> 0").groupBy("video_id").agg(F.count("*").alias("comment_count")).withColumn("view_count", F.col("comment_count") * 10)
    return video_api.with_statistics(d.select("video_id", F.lit("t").alias("title")), stats, 3)


@query(f"WITH {_COUNTS} SELECT video_id, coalesce(c, 0) AS comment_count, coalesce(c, 0) * 10 AS view_count FROM videos LEFT JOIN counts USING (video_id) WHERE c >= 3")
def video_statistics(spark, sf_dir):
    return _videos(spark, sf_dir).select("video_id", "comment_count", "view_count")


@query(f"WITH {_COUNTS} SELECT coalesce(sum(c), 0)::BIGINT AS comments FROM counts WHERE c >= 3")
def comments_available(spark, sf_dir):
    return video_api.comments_available(_videos(spark, sf_dir))


@query(f"WITH {_COUNTS} SELECT video_id FROM (SELECT *, row_number() OVER (ORDER BY video_id) AS k FROM counts WHERE c >= 3) WHERE k % 2 = 1")
def videos_to_pull(spark, sf_dir):
    """Videos written by size, every second marked as pulled, and those still to pull read."""
    from pyspark.sql import Window

    path = _folder(spark, "videos")
    k = F.row_number().over(Window.orderBy("video_id"))  # a row for each video
    sinks.write_videos(_videos(spark, sf_dir).withColumn("pulled", F.when(k % 2 == 0, " Yes").otherwise("")), path)
    return readers.videos_to_pull(spark, path).select("video_id")


# --- texts and vectors --------------------------------------------------------------------------------


@query(O.sql(O.POOL + f",\nmix AS (SELECT * FROM pool ORDER BY {O.shuffled(seed=42)}, comment_id LIMIT 50)", f"SELECT comment_id, row_number() OVER (ORDER BY {O.shuffled(seed=42)}, comment_id) AS pass1, row_number() OVER (ORDER BY {O.shuffled(seed=43)}, comment_id) AS pass2 FROM mix"))
def pilot_passes(spark, sf_dir):
    """A pilot batch in two orders."""
    got = S.pilot_passes(S.pilot(R.pool(spark, sf_dir), 50))
    return got.select("comment_id", F.col("pass1").cast("long").alias("pass1"), F.col("pass2").cast("long").alias("pass2"))


@query(r"SELECT doc_id, to_json(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))::VARCHAR AS line FROM documents")
def flat_text(spark, sf_dir):
    """Texts on one line as JSON strings."""
    d = R.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", T.flat_json(F.col("text")).alias("line"))


@query("WITH v AS (SELECT label, vec_id % 20 AS g, vec_id % 3 <> 0 AS m, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), means AS (SELECT g, i, coalesce(avg(x) FILTER (m), 0) AS x FROM v GROUP BY ALL) SELECT g, CAST(i AS BIGINT) AS dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY g)), 1e-9), 6) AS value FROM means")
def masked_means(spark, sf_dir):
    """Masked means: twenty texts, whose states are embeddings."""
    e = R.table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 20).alias("g")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("e"))
    mask = F.transform("e", lambda x: F.when(x.vec_id % 3 != 0, 1).otherwise(0))
    got = e.select("g", FE.masked_mean(F.col("e.embedding"), mask, 64).alias("v"))
    return got.select("g", F.posexplode("v").alias("dim", "value")).select("g", (F.col("dim") + 1).cast("long").alias("dim"), six("value"))
