"""Corpus build: routing, copypasta, exact and reordered duplicates, neighbour languages, screen.

Every raw row gets exactly one outcome in ``drop_reason`` or ``pool``; the pools and the report are
filters and counts over that one lineage.  "First" means the least ``seq``, an explicit order
that the reader attaches; no operator relies on the order of rows in a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.profiles import KAZAKH_RUSSIAN, LanguagePair
from corpusloom.storage import materialise

COPYPASTA_VIDEOS = 3


def first_by(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """One row for each key, that of least ``seq``: a partially aggregated minimum, so hot keys cost nothing extra."""
    others = [c for c in df.columns if c not in (key, seq)]
    picked = df.groupBy(key).agg(F.min(F.struct(seq, *others)).alias("_first"))
    return picked.select(*(F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns))


def clean_text(raw: DataFrame) -> DataFrame:
    """Anonymised text with runs collapsed; a null text counts as empty."""
    return raw.withColumn("text", T.collapse_repeats(T.anonymize(F.coalesce("text", F.lit("")))))


def route(rows: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN, max_chars: int = T.MAX_CHARS) -> DataFrame:
    """``rows`` with ``status`` and ``reason`` of the row rules."""
    return rows.withColumn("_o", T.classify_row(F.col("text"), pair, max_chars)).withColumns({"status": F.col("_o.status"), "reason": F.col("_o.reason")}).drop("_o")


def copypasta_keys(rows: DataFrame, least: int = COPYPASTA_VIDEOS) -> DataFrame:
    """``norm_key, n_videos``: texts under ``least`` distinct videos or more, over all rows, dropped or not.

    Pairs of key and video are made distinct before they are counted, so a key's rows spread over many tasks.
    """
    keyed = rows.select(T.norm_key(F.col("text")).alias("norm_key"), "video_id").distinct()
    return keyed.groupBy("norm_key").agg(F.count("*").alias("n_videos")).where(F.col("n_videos") >= least)


def keyed(rows: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN, *keep: str) -> DataFrame:
    """``seq, video_id, status, reason, norm_key, token_key`` of routed rows, and the columns ``keep``: all that deduplication reads of a text."""
    return rows.select("seq", "video_id", "status", "reason", T.norm_key(F.col("text")).alias("norm_key"), T.token_key(F.col("text"), pair).alias("token_key"), *keep)


def outcomes(keys: DataFrame, copypasta: int = COPYPASTA_VIDEOS) -> DataFrame:
    """``keys`` with ``drop_reason``: the row rules, copypasta, exact and reordered duplicates; null for survivors.

    Only survivors of one step take part in the next.  One aggregation by ``norm_key`` tells whether a text is copypasta and
    which of its rows is the first that passed the rules; another, over those first rows alone, which of them is the first of
    its ``token_key``.  Both are partially aggregated before they move.  ``keys`` is read three times, so it should be stored.
    """
    passed = F.when(F.col("status") != "drop", F.struct("seq", "token_key"))
    by_video = keys.groupBy("norm_key", "video_id").agg(F.min(passed).alias("first"))
    texts = by_video.groupBy("norm_key").agg(F.min("first").alias("_first"), (F.count("video_id") >= copypasta).alias("_pasted"))
    firsts = texts.where(~F.col("_pasted") & F.col("_first.token_key").isNotNull())
    same = firsts.groupBy(F.col("_first.token_key").alias("token_key")).agg(F.min("_first.seq").alias("_earliest"))
    reason = (
        F.when(F.col("status") == "drop", F.col("reason"))
        .when(F.col("_pasted"), "copypasta")
        .when(F.col("seq") > F.col("_first.seq"), "exact_duplicate")
        .when(F.col("seq") > F.col("_earliest"), "reordered_duplicate")
    )
    return keys.join(texts, "norm_key", "left").join(same, "token_key", "left").select(*keys.columns, reason.alias("drop_reason"))


def dedup(rows: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN, copypasta: int = COPYPASTA_VIDEOS) -> DataFrame:
    """Routed rows with ``norm_key, token_key, drop_reason``; texts are read once for their keys, which are stored, and once for the result."""
    found = outcomes(materialise(keyed(rows, pair), "keys"), copypasta)
    return rows.join(found.select("seq", "norm_key", "token_key", "drop_reason"), "seq").select(*rows.columns, "norm_key", "token_key", "drop_reason")


# --- screen by closed word lists -------------------------------------------------------------------


def screen_counts(text: Column, pair: LanguagePair = KAZAKH_RUSSIAN) -> Column:
    """struct(a, b): words that vote for each language; list b is asked before list a and its letters."""
    return _votes(F.filter(T.tokenize(text, pair), lambda w: ~w.isin(*pair.screen_neutral)), pair)


def _votes(voting: Column, pair: LanguagePair) -> Column:
    only_a = [w for w in pair.screen_a if w not in pair.screen_ambiguous]
    b = F.size(F.filter(voting, lambda w: w.isin(*pair.screen_b)))
    a = F.size(F.filter(voting, lambda w: ~w.isin(*pair.screen_b) & (w.isin(*only_a) | T.has_any(w, pair.letters_a))))
    return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))


def screen(rows: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN) -> DataFrame:
    """``rows`` with ``screen_a, screen_b, screen_bucket``."""
    voting = F.filter(T.tokenize(F.col("text"), pair), lambda w: ~w.isin(*pair.screen_neutral))
    out = rows.withColumn("_v", voting).withColumn("_s", _votes(F.col("_v"), pair)).drop("_v")  # split once for both counts
    return out.withColumns({"screen_a": F.col("_s.a"), "screen_b": F.col("_s.b")}).withColumn("screen_bucket", T.density_bucket(F.col("screen_a"), F.col("screen_b"))).drop("_s")


def screen_report(screened: DataFrame) -> DataFrame:
    """One row: the size of each bucket, and mixed texts as a share of all and of those with a signal."""
    count = {b: F.count_if(F.col("screen_bucket") == b) for b in ("mono", "low", "med", "high", "unknown")}
    got = screened.agg(F.count("*").alias("total"), *(c.alias(b) for b, c in count.items())).withColumn("mixed", F.expr("low + med + high"))
    share = lambda below: F.coalesce(F.try_divide("mixed", below), F.lit(0.0))
    return got.withColumns({"mixed_of_all": share(F.col("total")), "mixed_of_signal": share(F.col("total") - F.col("unknown"))})


def screen_by_video(screened: DataFrame) -> DataFrame:
    """Bucket sizes and the mixed share of each video, the most mixed first."""
    got = screened.groupBy("video_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("screen_bucket") == b).alias(b) for b in ("mono", "low", "med", "high", "unknown")))
    mixed = F.expr("low + med + high")
    return got.withColumn("mixed", mixed).withColumn("mixed_share", F.col("mixed") / F.col("total")).orderBy(F.desc("mixed_share"), F.desc("video_id"))


# --- neighbour languages ---------------------------------------------------------------------------


def word_scores(words: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN) -> DataFrame:
    """``word`` with a score for each neighbour and ``evidence``; for a table of distinct words.

    A word is marked if it is a marker, or starts with one of four letters or more and is at most four longer.
    """
    columns = {"evidence": T.has_any(F.col("word"), pair.evidence_letters).cast("long")}
    for n in pair.neighbours:
        marked = F.col("word").isin(*n.markers)
        for m in n.markers:
            if len(m) >= 4:
                marked = marked | (F.col("word").startswith(m) & (F.length("word") <= len(m) + 4))
        total = F.when(marked, 2).otherwise(0) + F.when(T.has_any(F.col("word"), n.letters), n.letter_weight).otherwise(0)
        for p in n.patterns:
            total = total + F.when(F.col("word").rlike(p), 1).otherwise(0)
        columns[n.code] = total.cast("long")
    return words.withColumns(columns)


def language_scores(rows: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN, key: str = "seq") -> DataFrame:
    """``key, n, evidence`` and a score for each neighbour, of every row.

    Distinct words are scored once and joined back; the words of the main script alone take part.
    """
    pattern = f"[{pair.main_class}]+"
    # Three steps read these; storing them spares two more passes of the patterns over the texts.
    listed = materialise(rows.select(key, F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.lower).alias("w")), "words")
    counted = listed.select(key, F.explode("w").alias("word")).groupBy(key, "word").agg(F.count("*").alias("c"))
    scored = word_scores(counted.select("word").distinct(), pair)
    names = ["evidence", *(n.code for n in pair.neighbours)]
    some = scored.where(" or ".join(f"{n} > 0" for n in names))
    sums = counted.join(some, "word").groupBy(key).agg(*(F.sum(F.col("c") * F.col(n)).alias(n) for n in names))
    return listed.select(key, F.size("w").cast("long").alias("n")).join(sums, key, "left").select(key, "n", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names))


def detect(pair: LanguagePair = KAZAKH_RUSSIAN) -> Column:
    """The neighbour language of a row with ``language_scores``; null if it is none of them.

    A neighbour with letters of its own needs a score of 3; those after the first also little evidence of the
    pair.  One without its own letters needs 2 and no evidence, or 6 and little.
    """
    out = F.when(F.col("n") < 3, F.lit(None).cast("string"))
    for k, n in enumerate(pair.neighbours):
        little = F.col("evidence") <= 1
        if n.letters:
            hit = F.col(n.code) >= 3
            hit = hit if k == 0 else hit & little
        else:
            hit = ((F.col(n.code) >= 2) & (F.col("evidence") == 0)) | ((F.col(n.code) >= 6) & little)
        out = out.when(hit, n.code)
    return out


def corpus_outcomes(raw: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN, max_chars: int = T.MAX_CHARS) -> DataFrame:
    """The outcome of every row of ``raw`` (comment_id, video_id, source_file, text, seq, ...), the first of each comment, without its text.

    Columns: ``seq, comment_id, video_id, source_file, status, reason, norm_key, token_key, n_tokens, screen_a, screen_b, screen_bucket, drop_reason,
    language, pool, density_eligible``.  Texts are read twice: once for all that is known of a row by itself, which is stored, and once
    for the languages of the rows kept.
    """
    own = ("comment_id", "source_file", "n_tokens", "screen_a", "screen_b", "screen_bucket")
    rows = screen(route(clean_text(raw), pair, max_chars), pair).withColumn("n_tokens", T.n_tokens(F.col("text"), pair))
    whole = materialise(keyed(rows, pair, *own), "keys")
    firsts = materialise(first_by(whole, "comment_id"), "firsts")  # read three times
    done = materialise(outcomes(firsts), "outcomes")
    kept = clean_text(raw.join(done.where(F.col("drop_reason").isNull()).select("seq"), "seq", "left_semi"))
    language = language_scores(kept, pair).withColumn("language", detect(pair)).select("seq", "language").where("language is not null")
    out = done.join(language, "seq", "left").withColumn("drop_reason", F.coalesce("drop_reason", F.concat(F.lit("other_language_"), "language")))
    pool = F.when(F.col("language").isNotNull(), "otherlang").when(F.col("drop_reason").isNotNull(), None).when(F.col("status") == "romanized", "romanized").otherwise("clean")
    return out.withColumns({"pool": pool, "density_eligible": F.col("status") == "ok"})


def build_corpus(raw: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN, max_chars: int = T.MAX_CHARS) -> DataFrame:
    """All rows of ``raw``, the first of each comment, with their cleaned text and their outcome.

    Adds ``drop_reason`` (null if kept), ``language``, ``pool`` (clean, romanized, otherlang or null), ``n_tokens``, the
    screen's columns and ``density_eligible``.  Rows of other languages are in their pool and also count as dropped.
    """
    found = corpus_outcomes(raw, pair, max_chars)
    return clean_text(raw).join(found.drop("comment_id", "video_id", "source_file"), "seq")


def drop_report(done: DataFrame) -> DataFrame:
    """``drop_reason, n, share`` of the dropped rows, with a row ``total``; shares are of all rows.  One aggregation."""
    counts = done.groupBy("drop_reason").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy())  # over a row for each reason
    shares = counts.withColumn("whole", whole).where("drop_reason is not null")
    return shares.rollup("drop_reason").agg(F.sum("n").alias("n"), F.max("whole").alias("whole")).where("whole is not null").select(F.coalesce("drop_reason", F.lit("total")).alias("drop_reason"), "n", (F.col("n") / F.col("whole")).alias("share"))


def input_counts(rows: DataFrame) -> DataFrame:
    """Rows of each source file and ``total``."""
    return rows.rollup("source_file").agg(F.count("*").alias("n")).select(F.coalesce("source_file", F.lit("total")).alias("source_file"), "n")


def bucket_report(done: DataFrame) -> DataFrame:
    """Screen buckets of the clean pool: all, and those eligible for density."""
    return done.where("pool = 'clean'").groupBy("screen_bucket").agg(F.count("*").alias("n"), F.count_if("density_eligible").alias("eligible"))
