"""All registered queries of the corpus operators, each beside its DuckDB form.

Counts are bigint and computed doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import statistics as ST
from corpusloom.functions import text as T
from corpusloom.operators import annotation as A
from corpusloom.operators import corpus as C
from corpusloom.operators import density as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import features as FE
from corpusloom.operators import folds as FO
from corpusloom.operators import models as M
from corpusloom.operators import sampling as S
from corpusloom.storage import materialise

from . import oracle as O
from . import roles as R

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
PAIR = R.PAIR
BUDGET, NATURAL, RETEST, BATCH = 300, 60, 40, 50


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL form if it has one."""

    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = oracle
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def six(name: str):
    return F.round(F.col(name), 6).alias(name)


# --- build ------------------------------------------------------------------------------------------


@query(O.sql(O.dedup(), "SELECT coalesce(drop_reason, 'total') AS drop_reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM deduped WHERE drop_reason IS NOT NULL GROUP BY ROLLUP (drop_reason)"))
def drop_report(spark, sf_dir):
    return C.drop_report(R.outcomes(spark, sf_dir)).select("drop_reason", "n", six("share"))


@query(O.sql(O.dedup(), "SELECT seq, status, drop_reason, norm_key, token_key FROM deduped"))
def dedup_outcome(spark, sf_dir):
    return R.outcomes(spark, sf_dir).select("seq", "status", "drop_reason", "norm_key", "token_key")


@query(O.sql(O.TXT, f"SELECT {O.NORM_KEY} AS norm_key, count(DISTINCT video_id) AS n_videos FROM txt GROUP BY 1 HAVING count(DISTINCT video_id) >= 3"))
def copypasta_keys(spark, sf_dir):
    return C.copypasta_keys(R.cleaned(spark, sf_dir))


@query(O.sql(O.routed(), "SELECT seq, split_part(outcome, ':', 1) AS status, split_part(outcome, ':', 2) AS reason FROM routed"))
def row_router(spark, sf_dir):
    return C.route(R.cleaned(spark, sf_dir), PAIR).select("seq", "status", "reason")


@query(O.sql(O.TXT, f"SELECT seq, text, CAST(len({O.tokens('text')}) AS BIGINT) AS n_tokens, CASE WHEN {O.any_of('text', PAIR.main_class)} THEN 'latin' WHEN {O.any_of('text', PAIR.other_class)} THEN 'cyrillic' ELSE 'none' END AS script FROM txt"))
def token_stats(spark, sf_dir):
    text = F.col("text")
    return R.cleaned(spark, sf_dir).select("seq", "text", T.n_tokens(text, PAIR).alias("n_tokens"), T.script_of(text, PAIR).alias("script"))


@query(O.sql(O.TXT, f"SELECT seq, array_to_string({O.lowered('text')}, ' ') AS words, translate(lower(text), '{PAIR.accents[0]}', '{PAIR.accents[1]}') AS bare FROM txt"))
def word_split(spark, sf_dir):
    text = F.col("text")
    return R.cleaned(spark, sf_dir).select("seq", F.array_join(T.words(text, PAIR), " ").alias("words"), T.deaccent(F.lower(text), PAIR).alias("bare"))


@query("SELECT coalesce(lang, 'total') AS source_file, count(*) AS n FROM documents GROUP BY ROLLUP (lang)")
def input_counts(spark, sf_dir):
    return C.input_counts(R.raw(spark, sf_dir))


@query(f"""WITH {O.TXT.strip()}
SELECT seq FROM txt WHERE length(text) BETWEEN 3 AND 500 AND {O.any_of('text', PAIR.main_class)} AND NOT (contains(text, '<URL>') AND length(text) < 20)""")
def pilot_usable(spark, sf_dir):
    return R.cleaned(spark, sf_dir).where(T.is_usable(F.col("text"), PAIR)).select("seq")


@query()
def corpus_outcome(spark, sf_dir):
    """Every document's pool or reason, neighbour languages included."""
    done = C.corpus_outcomes(R.raw(spark, sf_dir), PAIR, R.NO_LIMIT)
    return done.select("comment_id", "pool", "drop_reason", "language", "n_tokens", "screen_a", "screen_b", "screen_bucket", "density_eligible")


_oracles["corpus_outcome"] = O.sql(
    f"""{O.dedup(R.NO_LIMIT)},{O.language_scores().split(',', 2)[2].split('AS text FROM anonymous),', 1)[1]},
lang AS (SELECT seq, {O.detected()} AS language FROM scores),{O.screened().split('AS text FROM anonymous),', 1)[1]}""",
    f"""SELECT d.seq AS comment_id, CASE WHEN drop_reason IS NOT NULL THEN NULL WHEN language IS NOT NULL THEN 'otherlang' WHEN status = 'romanized' THEN 'romanized' ELSE 'clean' END AS pool,
CASE WHEN drop_reason IS NULL AND language IS NOT NULL THEN 'other_language_' || language ELSE drop_reason END AS drop_reason, CASE WHEN drop_reason IS NULL THEN language END AS language,
CAST(len({O.tokens('d.text')}) AS BIGINT) AS n_tokens, screen_a, screen_b, screen_bucket, status = 'ok' AS density_eligible FROM deduped d JOIN lang USING (seq) JOIN screened s ON s.seq = d.seq""",
)


@query(O.sql(O.screened() + f", routed_ AS (SELECT seq, {O.NORM_KEY} AS k FROM txt)", f"SELECT screen_bucket, count(*) AS n, count(*) FILTER (len({O.tokens('text')}) >= 5) AS eligible FROM screened GROUP BY screen_bucket"))
def bucket_report(spark, sf_dir):
    rows = R.screened(spark, sf_dir).withColumns({"pool": F.lit("clean"), "density_eligible": T.n_tokens(F.col("text"), PAIR) >= T.MIN_DENSITY_TOKENS})
    return C.bucket_report(rows)


# --- screen and neighbour languages -----------------------------------------------------------------


@query(O.sql(O.screened(), "SELECT seq, screen_a, screen_b, screen_bucket FROM screened"))
def screen_buckets(spark, sf_dir):
    return R.screened(spark, sf_dir).select("seq", "screen_a", "screen_b", "screen_bucket")


_MIXED = "count(*) FILTER (screen_bucket IN ('low', 'med', 'high'))"
_EACH = ", ".join(f"count(*) FILTER (screen_bucket = '{b}') AS {b}" for b in ("mono", "low", "med", "high", "unknown"))


@query(O.sql(O.screened(), f"SELECT count(*) AS total, {_EACH}, {_MIXED} AS mixed, round(coalesce({_MIXED} / nullif(count(*), 0), 0), 6) AS mixed_of_all, round(coalesce({_MIXED} / nullif(count(*) FILTER (screen_bucket <> 'unknown'), 0), 0), 6) AS mixed_of_signal FROM screened"))
def screen_report(spark, sf_dir):
    return C.screen_report(R.screened(spark, sf_dir)).select("total", "mono", "low", "med", "high", "unknown", "mixed", six("mixed_of_all"), six("mixed_of_signal"))


@query(O.sql(O.screened(), f"SELECT video_id, count(*) AS total, {_EACH}, {_MIXED} AS mixed, round({_MIXED} / count(*), 6) AS mixed_share FROM screened GROUP BY video_id"))
def screen_by_source(spark, sf_dir):
    return C.screen_by_video(R.screened(spark, sf_dir)).select("video_id", "total", "mono", "low", "med", "high", "unknown", "mixed", six("mixed_share"))


@query(O.sql(O.screened(), "SELECT seq, screen_bucket FROM (SELECT *, row_number() OVER (PARTITION BY screen_bucket ORDER BY seq) AS k FROM screened) WHERE k <= 5"))
def screen_examples(spark, sf_dir):
    return S.first_of_each(R.screened(spark, sf_dir), "screen_bucket", 12).select("seq", "screen_bucket")


@query(O.sql(O.language_scores(), "SELECT * FROM scores"))
def lang_scores(spark, sf_dir):
    return C.language_scores(R.cleaned(spark, sf_dir), PAIR)


@query(O.sql(O.language_scores(), f"SELECT {O.detected()} AS language, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM scores GROUP BY 1"))
def lang_detect(spark, sf_dir):
    got = C.language_scores(R.cleaned(spark, sf_dir), PAIR).groupBy(C.detect(PAIR).alias("language")).agg(F.count("*").alias("n"))
    return got.select("language", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


# --- density ----------------------------------------------------------------------------------------


def _frequencies(spark, sf_dir):
    return D.word_frequencies(D.document_sides(R.cleaned(spark, sf_dir), PAIR), PAIR)


@query(O.sql(O.frequencies(), "SELECT txt.seq, side FROM txt LEFT JOIN sides USING (seq)"))
def document_sides(spark, sf_dir):
    return D.document_sides(R.cleaned(spark, sf_dir), PAIR).select("seq", "side")


@query(O.sql(O.frequencies(), "SELECT * FROM freq"))
def word_freq_by_side(spark, sf_dir):
    return _frequencies(spark, sf_dir)


@query(O.sql(O.seeds(), "SELECT word, lang, n FROM seeded"))
def seed_words(spark, sf_dir):
    return D.seed_words(_frequencies(spark, sf_dir), PAIR)


@query(O.sql(O.chars(), "SELECT 'ctx' AS kind, ctx AS key, CAST(coalesce(a, 0) AS BIGINT) AS a, CAST(coalesce(b, 0) AS BIGINT) AS b FROM ctx UNION ALL SELECT 'gram', gram, CAST(coalesce(a, 0) AS BIGINT), CAST(coalesce(b, 0) AS BIGINT) FROM gram UNION ALL SELECT 'alphabet', '', va, vb FROM alphabet"))
def char_lm_counts(spark, sf_dir):
    return D.char_model(D.seed_words(_frequencies(spark, sf_dir), PAIR), PAIR)


@query(O.sql(O.chars() + ", asked AS (SELECT word FROM freq)," + O.llr("asked", "scored"), "SELECT word, round(llr, 6) AS llr FROM scored"))
def word_llr(spark, sf_dir):
    freq = materialise(_frequencies(spark, sf_dir), "frequencies")
    return D.word_llr(freq.select("word"), D.char_model(D.seed_words(freq, PAIR), PAIR)).select("word", six("llr"))


def _model(spark, sf_dir) -> D.DensityModel:
    return D.assemble(_frequencies(spark, sf_dir), PAIR)


@query(O.sql(O.measured(), "SELECT * FROM lexicon"))
def lexicon(spark, sf_dir):
    return _model(spark, sf_dir).lexicon


@query(O.sql(O.measured(), "SELECT form, collision FROM collided"))
def stripped_forms(spark, sf_dir):
    return _model(spark, sf_dir).stripped


@query(O.sql(O.measured(), "SELECT seq, a, b, shared, counted, density, base_lang FROM measured"))
def density_measure(spark, sf_dir):
    return D.measure(R.cleaned(spark, sf_dir), _model(spark, sf_dir)).select("seq", "a", "b", "shared", "counted", "density", "base_lang")


@query(O.sql(O.measured(), "SELECT density, base_lang, count(*) AS n FROM measured GROUP BY ALL"))
def density_buckets(spark, sf_dir):
    return D.measure(R.cleaned(spark, sf_dir), _model(spark, sf_dir)).groupBy("density", "base_lang").agg(F.count("*").alias("n"))


# --- samples ----------------------------------------------------------------------------------------

_NATURAL = f"{O.POOL},\nnatural_ AS (SELECT * FROM pool ORDER BY {O.shuffled()}, comment_id LIMIT {NATURAL}),\nremainder AS (SELECT * FROM pool WHERE comment_id NOT IN (SELECT comment_id FROM natural_) AND density_eligible)"
_ALLOCATED = f"""{_NATURAL},
avail AS (SELECT s, i, (SELECT count(*) FROM remainder WHERE screen_bucket = s) AS available FROM (SELECT unnest(['high', 'med', 'low', 'unknown', 'mono']) AS s, unnest([0, 1, 2, 3, 4]) AS i)),
a0 AS (SELECT s, available, least(available, CAST({BUDGET} AS BIGINT)) AS taken FROM avail WHERE i = 0),
a1 AS (SELECT a.s, a.available, greatest(0, least(a.available, CAST(ceil(({BUDGET} - (SELECT sum(taken) FROM a0)) / 4) AS BIGINT))) AS taken FROM avail a WHERE i = 1),
a2 AS (SELECT a.s, a.available, greatest(0, least(a.available, CAST(ceil(({BUDGET} - (SELECT sum(taken) FROM a0) - (SELECT sum(taken) FROM a1)) / 3) AS BIGINT))) AS taken FROM avail a WHERE i = 2),
a3 AS (SELECT a.s, a.available, greatest(0, least(a.available, CAST(ceil(({BUDGET} - (SELECT sum(taken) FROM a0) - (SELECT sum(taken) FROM a1) - (SELECT sum(taken) FROM a2)) / 2) AS BIGINT))) AS taken FROM avail a WHERE i = 3),
a4 AS (SELECT a.s, a.available, greatest(0, least(a.available, CAST({BUDGET} - (SELECT sum(taken) FROM a0) - (SELECT sum(taken) FROM a1) - (SELECT sum(taken) FROM a2) - (SELECT sum(taken) FROM a3) AS BIGINT))) AS taken FROM avail a WHERE i = 4),
alloc AS (SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a4)"""
_ENRICHED = f"""{_ALLOCATED},
rounds AS (SELECT *, row_number() OVER (PARTITION BY screen_bucket, video_id ORDER BY {O.shuffled()}, comment_id) AS r, count(*) OVER (PARTITION BY screen_bucket, video_id) AS size FROM remainder),
dealt AS (SELECT *, row_number() OVER (PARTITION BY screen_bucket ORDER BY r, size DESC, video_id) AS k FROM rounds),
enriched AS (SELECT comment_id, video_id, screen_bucket, n_tokens, density_eligible FROM dealt JOIN alloc ON s = screen_bucket WHERE k <= taken)"""
_RETEST = f"""{_ENRICHED},
sampled AS (SELECT * FROM natural_ UNION ALL SELECT * FROM enriched),
first_ AS (SELECT *, row_number() OVER (PARTITION BY screen_bucket ORDER BY {O.shuffled(seed=2027)}, comment_id) <= greatest(1, least({RETEST}, count(*) OVER ()) // (SELECT count(DISTINCT screen_bucket) FROM sampled)) AS f FROM sampled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY {O.shuffled(seed=2027)}, comment_id) AS k FROM first_),
retest_ AS (SELECT * FROM ranked WHERE f OR k <= least({RETEST}, (SELECT count(*) FROM sampled)) - (SELECT count(*) FROM first_ WHERE f))"""
_BATCHED = "lpad(CAST((row_number() OVER (ORDER BY {order}, comment_id) - 1) // {size} + 1 AS VARCHAR), 2, '0')"


def _drawn(spark, sf_dir):
    pool = R.pool(spark, sf_dir)
    natural = S.natural_probe(pool, NATURAL)
    enriched, strata = S.enriched_draw(pool, natural, BUDGET, "screen_bucket", S.SCREEN_ORDER, ("high",))
    return pool, natural, enriched, strata


@query(O.sql(_NATURAL, "SELECT comment_id, video_id, screen_bucket FROM natural_"))
def natural_probe(spark, sf_dir):
    return S.natural_probe(R.pool(spark, sf_dir), NATURAL).select("comment_id", "video_id", "screen_bucket")


@query(O.sql(_ALLOCATED, "SELECT s AS stratum, available, taken, round(coalesce(taken / nullif(available, 0), 0), 6) AS p FROM alloc"))
def allocation(spark, sf_dir):
    pool = R.pool(spark, sf_dir)
    rest = pool.join(S.natural_probe(pool, NATURAL).select("comment_id"), "comment_id", "left_anti").where("density_eligible")
    available = rest.groupBy(F.col("screen_bucket").alias("stratum")).agg(F.count("*").alias("available"))
    return S.allocation(available, BUDGET, S.SCREEN_ORDER, ("high",)).select("stratum", "available", "taken", six("p"))


@query(O.sql(_ENRICHED, "SELECT comment_id, video_id, screen_bucket FROM enriched"))
def enriched_draw(spark, sf_dir):
    return _drawn(spark, sf_dir)[2].select("comment_id", "video_id", "screen_bucket")


@query(O.sql(_RETEST, "SELECT comment_id, screen_bucket FROM retest_"))
def retest_draw(spark, sf_dir):
    _, natural, enriched, _ = _drawn(spark, sf_dir)
    return S.retest_draw(natural.unionByName(enriched), RETEST, "screen_bucket").select("comment_id", "screen_bucket")


@query(O.sql(_NATURAL, f"SELECT comment_id, 'natural_' || {_BATCHED.format(order=O.shuffled(), size=BATCH)} AS batch FROM natural_"))
def batch_numbers(spark, sf_dir):
    return S.batches(S.natural_probe(R.pool(spark, sf_dir), NATURAL), "natural", BATCH).select("comment_id", "batch")


_MANIFEST_ROW = "comment_id, '{name}_' || " + _BATCHED.replace("{order}", O.shuffled()).replace("{size}", str(BATCH)) + " AS batch, '{name}' AS sample, screen_bucket AS stratum, screen_bucket, video_id, n_tokens, density_eligible, {p} AS inclusion_prob"


@query(
    O.sql(
        _RETEST,
        "SELECT " + _MANIFEST_ROW.format(name="natural", p="printf('%.6f', (SELECT count(*) FROM natural_) / (SELECT count(*) FROM pool))") + " FROM natural_"
        " UNION ALL SELECT " + _MANIFEST_ROW.format(name="enriched", p="printf('%.6f', coalesce((SELECT taken / nullif(available, 0) FROM alloc WHERE s = screen_bucket), 0))") + " FROM enriched"
        " UNION ALL SELECT " + _MANIFEST_ROW.format(name="retest", p="''") + " FROM retest_",
    )
)
def inclusion_prob(spark, sf_dir):
    """The whole manifest."""
    pool, natural, enriched, strata = _drawn(spark, sf_dir)
    retest = S.retest_draw(natural.unionByName(enriched), RETEST, "screen_bucket")
    parts = [S.batches(df, name, BATCH) for df, name in ((natural, "natural"), (enriched, "enriched"), (retest, "retest"))]
    return S.manifest(*parts, pool.count(), strata, "screen_bucket")


@query(O.sql(_ENRICHED, "SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS videos, round(max(c) / sum(c), 6) AS largest_share FROM (SELECT video_id, count(*) AS c FROM enriched GROUP BY video_id)"))
def video_coverage(spark, sf_dir):
    return S.coverage(_drawn(spark, sf_dir)[2]).select("n", "videos", six("largest_share"))


@query(
    O.sql(
        O.POOL + f",\nmix AS (SELECT * FROM pool WHERE screen_bucket IN ('low', 'med', 'high') ORDER BY {O.shuffled(seed=42)}, comment_id LIMIT 25)",
        f"SELECT comment_id, screen_bucket FROM mix UNION ALL (SELECT comment_id, screen_bucket FROM pool WHERE screen_bucket NOT IN ('low', 'med', 'high') ORDER BY {O.shuffled(seed=42)}, comment_id LIMIT (SELECT 50 - count(*) FROM mix))",
    )
)
def pilot_batch(spark, sf_dir):
    return S.pilot(R.pool(spark, sf_dir), 50, 0.5).select("comment_id", "screen_bucket")


# --- annotation -------------------------------------------------------------------------------------

_DOM = {"sentiment": A.SENTIMENTS, "density": A.DENSITIES, "base_lang": A.LANGUAGES}


def _finding(axis: str) -> str:
    bad = f"'{axis}=''' || {axis} || '''' || coalesce('  (did you mean ''' || {O.typo(axis)} || '''?)', '')"
    if axis == "sentiment":
        return f"SELECT 'error' AS level, file, line, {bad} AS message FROM sheets WHERE sentiment <> '' AND sentiment NOT IN {O.words_in(_DOM[axis])}"
    return f"SELECT 'error' AS level, file, line, CASE WHEN {axis} = '' THEN 'sentiment filled but {axis} blank' ELSE {bad} END AS message FROM sheets WHERE sentiment NOT IN ('', 'skip') AND {axis} NOT IN {O.words_in(_DOM[axis])}"


@query(
    O.sql(
        O.SHEETS,
        " UNION ALL ".join(_finding(a) for a in _DOM)
        + " UNION ALL SELECT 'warning', file, line, 'sentiment=skip but density/base_lang filled - they will be discarded' FROM sheets WHERE sentiment = 'skip' AND (density <> '' OR base_lang <> '')"
        + " UNION ALL SELECT 'error', file, line, 'comment_id not in manifest - the cell was probably edited' FROM sheets WHERE line % 5 = 0",
    )
)
def validation_errors(spark, sf_dir):
    sheets = R.sheets(spark, sf_dir)
    return A.findings(sheets, sheets.where(F.col("line") % 5 != 0).select("comment_id"))


@query(
    O.sql(
        O.SHEETS,
        f"""SELECT comment_id, file, line, CASE WHEN sentiment = '' THEN 'blank' WHEN sentiment = 'skip' THEN 'skipped' WHEN sentiment NOT IN ('pos', 'neg', 'neu') OR density NOT IN {O.words_in(A.DENSITIES)} OR base_lang NOT IN {O.words_in(A.LANGUAGES)} THEN 'invalid' WHEN line % 9 = 0 THEN 'unknown' ELSE 'labelled' END AS outcome,
sentiment, density, base_lang, CASE WHEN line % 2 = 0 THEN 'natural' ELSE '' END AS sample FROM sheets""",
    )
)
def merge_labels(spark, sf_dir):
    d = R.table(spark, sf_dir, "documents").where(F.col("doc_id") % 9 != 0)
    clean = d.select(F.col("doc_id").cast("string").alias("comment_id"), "text", F.col("source").alias("video_id"), F.lit(0).alias("n_tokens"), F.lit(True).alias("density_eligible"), F.lit("mono").alias("screen_bucket"))
    manifest = R.table(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == 0).select(F.col("doc_id").cast("string").alias("comment_id"), F.lit("natural").alias("sample"), F.lit("0.5").alias("inclusion_prob"))
    return A.merge(R.sheets(spark, sf_dir), clean, manifest).select("comment_id", "file", "line", "outcome", "sentiment", "density", "base_lang", "sample")


@query(O.sql(O.SHEETS, "SELECT count(*) AS n, count(*) FILTER (sentiment = 'skip') AS skipped, round(count(*) FILTER (sentiment = 'skip') / count(*), 6) AS skip_rate, round(count(*) / greatest(1, count(*) FILTER (sentiment <> 'skip')), 6) AS pull_ratio FROM sheets WHERE sentiment <> ''"))
def skip_rate(spark, sf_dir):
    return E.skip_rate(A.labelled_rows(R.sheets(spark, sf_dir))).select("n", "skipped", six("skip_rate"), six("pull_ratio"))


@query(O.sql(O.SHEETS, "SELECT v AS value, count(sentiment) AS n, round(count(sentiment) / (SELECT count(*) FROM sheets WHERE sentiment <> ''), 6) AS share FROM (SELECT unnest(['pos', 'neg', 'neu', 'skip']) AS v) LEFT JOIN sheets ON sentiment = v GROUP BY v"))
def label_distribution(spark, sf_dir):
    return E.distribution(A.labelled_rows(R.sheets(spark, sf_dir)), "sentiment", A.SENTIMENTS).select("value", "n", six("share"))


@query(O.sql(O.SHEETS, "SELECT density, n, pos, neg, neu, round(greatest(pos, neg, neu) / n, 6) AS majority, greatest(pos, neg, neu) / n >= 0.8 AS degenerate FROM (SELECT density, count(*) AS n, count(*) FILTER (sentiment = 'pos') AS pos, count(*) FILTER (sentiment = 'neg') AS neg, count(*) FILTER (sentiment = 'neu') AS neu FROM sheets WHERE sentiment NOT IN ('', 'skip') GROUP BY density)"))
def labels_within_density(spark, sf_dir):
    rows = A.labelled_rows(R.sheets(spark, sf_dir)).where("sentiment <> 'skip'")
    return E.labels_within(rows, "density", "sentiment").select("density", "n", "pos", "neg", "neu", six("majority"), "degenerate")


@query("SELECT (SELECT count(*) FROM labels) AS n, count(*) FILTER (quality = toxic) AS agreed, round((count(*) FILTER (quality = toxic) / count(*) - p) / (1 - p), 6) AS kappa, 'slight - guideline needs work' AS wording, false AS meets_target FROM labels, (SELECT (sum(quality) * sum(toxic) + sum(1 - quality) * sum(1 - toxic)) / (count(*) * count(*)) AS p FROM labels) GROUP BY p")
def kappa(spark, sf_dir):
    """Agreement of the two label axes, as if two annotators had given one."""
    a = R.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("comment_id"), F.col("quality").cast("string").alias("sentiment"), F.col("toxic").cast("string").alias("_t"))
    pairs = E.label_pairs(a, a.select("comment_id", F.col("_t").alias("sentiment")), "sentiment")
    return E.agreement(pairs, 0.6).select("n", "agreed", six("kappa"), "wording", "meets_target")


@query(O.sql(O.SHEETS, "SELECT least(density, base_lang) AS x, greatest(density, base_lang) AS y, count(*) AS n FROM sheets WHERE density <> '' AND base_lang <> '' AND density <> base_lang GROUP BY ALL ORDER BY n DESC, x, y LIMIT 5"))
def confusions(spark, sf_dir):
    s = R.sheets(spark, sf_dir)
    other = s.select("comment_id", F.col("base_lang").alias("density"))
    return E.confusions(E.label_pairs(s, other, "density"))


@query(O.sql(O.SHEETS + "," + O.screened(), "SELECT n, agreed, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM (SELECT count(*) AS n, count(*) FILTER (a = b) AS agreed, count(*) FILTER (a IN ('low', 'med', 'high') AND b IN ('low', 'med', 'high')) AS tp, count(*) FILTER (a IN ('low', 'med', 'high') AND b NOT IN ('low', 'med', 'high')) AS fp, count(*) FILTER (a NOT IN ('low', 'med', 'high') AND b IN ('low', 'med', 'high')) AS fn FROM (SELECT screen_bucket AS a, density AS b FROM sheets JOIN screened ON seq = line WHERE sentiment NOT IN ('', 'skip')))"))
def screen_vs_label(spark, sf_dir):
    rows = A.labelled_rows(R.sheets(spark, sf_dir)).where("sentiment <> 'skip'")
    pairs = rows.join(R.screened(spark, sf_dir).select("seq", "screen_bucket"), F.col("line") == F.col("seq"))
    return E.detector_scores(pairs, "screen_bucket", "density").select("n", "agreed", "tp", "fp", "fn", six("precision"), six("recall"))


@query(O.sql(O.SHEETS + "," + O.screened(), "SELECT screen_bucket, " + ", ".join(f"count(*) FILTER (density = '{d}') AS {d}" for d in A.DENSITIES) + " FROM sheets JOIN screened ON seq = line WHERE sentiment NOT IN ('', 'skip') GROUP BY screen_bucket"))
def screen_grid(spark, sf_dir):
    rows = A.labelled_rows(R.sheets(spark, sf_dir)).where("sentiment <> 'skip'")
    return E.grid(rows.join(R.screened(spark, sf_dir).select("seq", "screen_bucket"), F.col("line") == F.col("seq")), "screen_bucket", "density", A.DENSITIES)


# --- folds ------------------------------------------------------------------------------------------

_FOLDS = f"""{O.LABELLED},
cells AS (SELECT doc_id AS comment_id, CASE WHEN quality = 1 THEN 'pos' ELSE 'neg' END || '|' || CASE WHEN n_chars < 1500 THEN 'low' ELSE 'high' END AS stratum FROM labelled),
numbered AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {O.shuffled()}, comment_id) AS k, CAST(round_even(count(*) OVER (PARTITION BY stratum) * CAST(0.15 AS DOUBLE), 0) AS BIGINT) AS t, CAST(('0x' || substr(md5('2026#' || stratum), 1, 8)) AS BIGINT) % 5 AS o FROM cells),
folds AS (SELECT comment_id, stratum, CASE WHEN k <= t THEN 'test' ELSE 'train' END AS split, CASE WHEN k > t THEN (k - t - 1 + o) % 5 END AS fold FROM numbered)"""


@query(O.sql(_FOLDS, "SELECT * FROM folds"))
def folds(spark, sf_dir):
    return FO.make_folds(R.labelled(spark, sf_dir)).select("comment_id", "stratum", "split", "fold")


@query(O.sql(_FOLDS, "SELECT CASE WHEN split = 'test' THEN 'test' ELSE 'fold ' || CAST(fold + 1 AS VARCHAR) END AS part, count(*) AS n, count(*) FILTER (stratum LIKE 'pos|%') AS pos, count(*) FILTER (stratum LIKE 'neg|%') AS neg FROM folds GROUP BY 1"))
def fold_balance(spark, sf_dir):
    return FO.fold_counts(FO.make_folds(R.labelled(spark, sf_dir)), "gold", ("pos", "neg"))


@query(O.sql(_FOLDS, "SELECT v AS value, min(n) AS least, min(n) < 20 AS thin FROM (SELECT v, f, count(comment_id) AS n FROM (SELECT unnest(['low', 'high']) AS v) CROSS JOIN (SELECT unnest(range(0, 5)) AS f) LEFT JOIN folds ON fold = f AND split_part(stratum, '|', 2) = v GROUP BY v, f) GROUP BY v"))
def fold_thin(spark, sf_dir):
    return FO.thin(FO.make_folds(R.labelled(spark, sf_dir)), "density", ("low", "high"), 5)


# --- features and models ----------------------------------------------------------------------------


def _tfidf_sql(terms: str, limit: int) -> str:
    return f"""{O.LABELLED},
terms AS (SELECT doc_id, unnest({terms}) AS term FROM labelled),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
vocabulary AS (SELECT term, count(*) AS df FROM tfs GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT {limit}),
raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM labelled)) / (1 + df)) + 1) AS w FROM tfs JOIN vocabulary USING (term)),
weighted AS (SELECT doc_id AS comment_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw)"""


_LOWER_TOKENS = f"regexp_extract_all(lower(text), '{O.TOKEN}')"
_WORD_TERMS = f"list_concat({_LOWER_TOKENS}, list_transform(range(1, len({_LOWER_TOKENS})), lambda i: {_LOWER_TOKENS}[i] || ' ' || {_LOWER_TOKENS}[i + 1]))"


@query(
    O.sql(
        _tfidf_sql("x", FE.WORD_FEATURES).replace("terms AS (SELECT doc_id, unnest(x) AS term FROM labelled)", f"split AS (SELECT doc_id, {_LOWER_TOKENS} AS l FROM labelled),\nterms AS (SELECT doc_id, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))) AS term FROM split)"),
        "SELECT * FROM weighted",
    )
)
def tfidf_word(spark, sf_dir):
    docs = R.labelled(spark, sf_dir)
    return FE.tfidf_word(PAIR).fit_transform(docs).select("comment_id", "term", six("weight"))


@query(
    O.sql(
        _tfidf_sql("x", FE.CHAR_FEATURES).replace(
            "terms AS (SELECT doc_id, unnest(x) AS term FROM labelled)",
            rf"""padded AS (SELECT doc_id, ' ' || unnest(list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda w: w <> '')) || ' ' AS w FROM labelled),
terms AS (SELECT doc_id, unnest(CASE WHEN length(w) <= 3 THEN [w] ELSE list_concat(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)), list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)), list_transform(range(1, length(w) - 3), lambda i: substr(w, i, 5))) END) AS term FROM padded)""",
        ),
        "SELECT * FROM weighted",
    )
)
def tfidf_char(spark, sf_dir):
    docs = R.labelled(spark, sf_dir)
    return FE.tfidf_char(PAIR).fit_transform(docs).select("comment_id", "term", six("weight"))


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS length, round(v[1] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-9), 6) AS first FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def doc_vector_norm(spark, sf_dir):
    e = R.table(spark, sf_dir, "embeddings")
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return FE.encoder_vectors(e.withColumn("_l", length)).join(e.select("vec_id", length.alias("length")), "vec_id").select("vec_id", six("length"), F.round(F.col("vector")[0], 6).alias("first"))


@query("WITH groups AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), means AS (SELECT label, i, avg(x) AS m FROM groups GROUP BY ALL) SELECT label, i AS dim, round(m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-9), 6) AS value FROM means")
def mean_vectors(spark, sf_dir):
    """Unit mean vectors: the embeddings as word vectors, their labels as texts."""
    e = R.table(spark, sf_dir, "embeddings")
    got = FE.mean_vectors(e.select("label", F.col("vec_id").alias("word")), e.select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector")), 64, "label")
    return got.select("label", F.posexplode("vector").alias("dim", "value")).select("label", (F.col("dim") + 1).cast("long").alias("dim"), six("value"))


@query(O.sql(_FOLDS, "SELECT comment_id, split_part(stratum, '|', 1) AS gold, round((SELECT count(*) FROM folds) / (2 * count(*) OVER (PARTITION BY split_part(stratum, '|', 1))), 6) AS weight FROM folds"))
def balanced_weights(spark, sf_dir):
    return M.balanced_weights(R.labelled(spark, sf_dir), "gold").select("comment_id", "gold", six("weight"))


@query()
def cv_predictions(spark, sf_dir):
    """Cross-validated predictions of two representations; fitted models have no SQL form.  Rows without a vector have none by ``xlmr``."""
    rows = M.settled(FO.make_folds(R.labelled(spark, sf_dir)))  # read by every fold
    vectors = FE.encoder_vectors(R.table(spark, sf_dir, "embeddings")).withColumnRenamed("vec_id", "comment_id")
    return M.cross_validate(rows, "tfidf_word", lambda: FE.tfidf_word(PAIR), "logreg").unionByName(M.cross_validate(rows, "xlmr", vectors, "svm"))


# --- evaluation -------------------------------------------------------------------------------------


@query(O.sql(O.label_scores("representation"), "SELECT representation, n, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy, round(floor, 6) AS floor, majority, round(accuracy - floor, 6) AS above_floor FROM scores"))
def macro_f1(spark, sf_dir):
    got = E.overall(E.aligned(E.one_classifier(R.predictions(spark, sf_dir))))
    return got.select("representation", "n", six("macro_f1"), six("accuracy"), six("floor"), "majority", six("above_floor"))


@query(O.sql(O.label_scores("density, representation"), "SELECT density, representation, n, round(macro_f1, 6) AS macro_f1, round(floor, 6) AS floor, n < 100 AS thin FROM scores"))
def bucket_metrics(spark, sf_dir):
    return E.by_bucket(E.aligned(R.predictions(spark, sf_dir))).select("density", "representation", "n", six("macro_f1"), six("floor"), "thin")


@query(O.sql(O.label_scores("density, representation"), "SELECT density, max(n) AS n, round(max(macro_f1) FILTER (representation = 'rep_a'), 6) AS best_f1, round(max(macro_f1) FILTER (representation <> 'rep_a'), 6) AS rest_f1, round(max(macro_f1) FILTER (representation = 'rep_a') - max(macro_f1) FILTER (representation <> 'rep_a'), 6) AS margin FROM scores GROUP BY density"))
def margins(spark, sf_dir):
    p = E.aligned(R.predictions(spark, sf_dir))
    return E.margins(E.by_bucket(p), E.best_representation(E.overall(p))).select("density", "n", six("best_f1"), six("rest_f1"), six("margin"))


@query(O.sql(O.label_scores("density, representation"), "SELECT s.density, s.representation, round((SELECT max(macro_f1) FROM scores o WHERE o.density = s.density AND o.representation <> s.representation), 6) AS rest_f1 FROM scores s"))
def best_of_rest(spark, sf_dir):
    return E.best_of_rest(E.by_bucket(R.predictions(spark, sf_dir))).select("density", "representation", six("rest_f1"))


@query(O.sql(O.SIGNIFICANCE, "SELECT a, b, scope, n, n01, n10, round(p, 6) AS p FROM tests"))
def mcnemar_pairs(spark, sf_dir):
    return E.significance(E.aligned(R.predictions(spark, sf_dir))).select("a", "b", "scope", "n", "n01", "n10", six("p"))


@query(O.sql(O.SIGNIFICANCE, "SELECT a, b, scope, round(p_holm, 6) AS p_holm, p_holm < 0.05 AS significant FROM adjusted"))
def holm(spark, sf_dir):
    return E.significance(E.aligned(R.predictions(spark, sf_dir))).select("a", "b", "scope", six("p_holm"), "significant")


_HALF = "1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))"


@query(f"SELECT source, k, n, round((k / n + 3.8416 / (2 * n) - {_HALF}) / (1 + 3.8416 / n), 6) AS low, round((k / n + 3.8416 / (2 * n) + {_HALF}) / (1 + 3.8416 / n), 6) AS high FROM (SELECT source, CAST(sum(quality) AS BIGINT) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def wilson(spark, sf_dir):
    j = R.table(spark, sf_dir, "documents").join(R.table(spark, sf_dir, "labels"), "doc_id")
    got = j.groupBy("source").agg(F.sum("quality").alias("k"), F.count("*").alias("n")).withColumn("w", ST.wilson(F.col("k"), F.col("n")))
    return got.select("source", "k", "n", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query(O.sql(O.PREDICTIONS, "SELECT density, count(*) AS n, median(n_tokens) AS median_tokens, round(avg(n_tokens), 6) AS mean_tokens FROM preds WHERE representation = 'rep_a' GROUP BY density"))
def length_control(spark, sf_dir):
    return E.length_control(R.predictions(spark, sf_dir)).select("density", "n", "median_tokens", six("mean_tokens"))


@query(O.sql(O.PREDICTIONS, "SELECT g AS gold, " + ", ".join(f"count(*) FILTER (pred = '{p}') AS {p}" for p in E.LABELS) + " FROM (SELECT unnest(['pos', 'neg', 'neu']) AS g) LEFT JOIN preds ON gold = g AND representation = 'rep_a' GROUP BY g"))
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(R.predictions(spark, sf_dir).where("representation = 'rep_a'"))


@query(O.sql(O.label_scores("density"), "SELECT density, round(floor, 6) AS floor, majority FROM scores"))
def majority_floor(spark, sf_dir):
    return ST.label_scores(R.predictions(spark, sf_dir), "gold", "pred", ("density",)).select("density", six("floor"), "majority")


@query("SELECT source, count(*) AS comment_count FROM documents GROUP BY source ORDER BY comment_count DESC, source LIMIT 10")
def top_sources(spark, sf_dir):
    got = R.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("comment_count"))
    return got.orderBy(F.desc("comment_count"), "source").limit(10)


from . import records  # noqa: E402, F401  (registers the queries over files)
