"""Annotation: sheets, validation, prompts and replies of a language model, merging.

Label cells are compared trimmed and in lower case.  Sheets carry ``file`` and ``line``; a message is ``file:line  what``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import cell, flat_json

SHEET_COLUMNS = ("comment_id", "text", "sentiment", "density", "base_lang", "notes")
# The label domains and the typing errors that validation explains.
SENTIMENTS = ("pos", "neg", "neu", "skip")
DENSITIES = ("mono", "low", "med", "high")
LANGUAGES = ("kk", "ru")
LIKELY_TYPOS = {
    "pos": "pos", "poz": "pos", "posit": "pos", "p": "pos", "+": "pos",
    "neg": "neg", "negative": "neg", "n": "neg", "-": "neg",
    "neu": "neu", "neutral": "neu", "net": "neu", "0": "neu",
    "mono": "mono", "m": "mono", "none": "mono",
    "hi": "high", "h": "high", "med": "med", "medium": "med", "l": "low",
    "kaz": "kk", "kz": "kk", "rus": "ru",
}
# The keys of the annotation interface.
SENTIMENT_KEYS = {"1": "pos", "2": "neg", "3": "neu", "0": "skip"}
DENSITY_KEYS = {"q": "mono", "w": "low", "e": "med", "r": "high"}
LANGUAGE_KEYS = {"k": "kk", "l": "ru"}


def require_columns(sheet: DataFrame, columns: tuple[str, ...] = SHEET_COLUMNS) -> DataFrame:
    """``sheet``, or ValueError that names the columns it lacks."""
    missing = [c for c in columns if c not in sheet.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return sheet


def is_done(r: str = "") -> Column:
    """A row is done if it is skipped, or has all three labels."""
    s, d, b = (F.trim(F.coalesce(F.col(r + c), F.lit(""))) for c in ("sentiment", "density", "base_lang"))
    return (s == "skip") | ((s != "") & (d != "") & (b != ""))


def press(sheet: DataFrame, keys: DataFrame) -> DataFrame:
    """``sheet`` after one key on each row of ``keys`` (comment_id, key), as the annotation interface takes it.

    A skip clears the other labels and shuts them; ``u`` clears the row.  Unknown keys change nothing; of several keys of one comment the least counts.
    """

    def of(table: dict[str, str], value: Column) -> Column:
        return F.create_map(*(F.lit(x) for x in chain(*table.items())))[value]

    pressed = keys.groupBy("comment_id").agg(F.min("key").alias("_key"))
    key = F.lower("_key")
    s, d, b = of(SENTIMENT_KEYS, F.col("_key")), of(DENSITY_KEYS, key), of(LANGUAGE_KEYS, key)
    clear, open_row = key == "u", F.coalesce("sentiment", F.lit("")) != "skip"
    wiped = F.coalesce(clear | (s == "skip"), F.lit(False))
    return (
        sheet.join(pressed, "comment_id", "left")
        .withColumns(
            {
                "sentiment": F.when(clear, "").otherwise(F.coalesce(s, "sentiment")),
                "density": F.when(wiped, "").when(d.isNotNull() & open_row, d).otherwise(F.col("density")),
                "base_lang": F.when(wiped, "").when(b.isNotNull() & open_row, b).otherwise(F.col("base_lang")),
            }
        )
        .select(*sheet.columns)
    )


def manifest_index(manifest: DataFrame, order: str = "line") -> DataFrame:
    """One row for each comment: a draw before a retest, the last of equals; without a column ``order``, the least of equals by value."""
    if order not in manifest.columns:
        manifest = manifest.withColumn(order, F.lit(0))
    best = F.struct(F.coalesce(F.col("sample") == "retest", F.lit(False)), -F.col(order), *(c for c in manifest.columns if c not in ("comment_id", order)))
    kept = manifest.groupBy("comment_id").agg(F.min(best).alias("_b"))
    return kept.select("comment_id", *(F.col(f"_b.{c}").alias(c) for c in manifest.columns if c not in ("comment_id", order)))


def findings(sheet: DataFrame, manifest: DataFrame | None = None, sentiments=SENTIMENTS, densities=DENSITIES, languages=LANGUAGES) -> DataFrame:
    """``level, file, line, message`` of all errors and warnings of annotated sheets.

    A comment twice in files that aren't retests is a warning; one that the manifest lacks an error, if the manifest has any.
    """
    typo = F.create_map(*(F.lit(x) for x in chain(*LIKELY_TYPOS.items())))
    cid = F.trim(F.coalesce("comment_id", F.lit("")))
    sent, dens, lang = cell(F.col("sentiment")), cell(F.col("density")), cell(F.col("base_lang"))

    def wrong(axis: str, value: Column) -> Column:
        hint = F.coalesce(F.concat(F.lit("  (did you mean '"), typo[value], F.lit("'?)")), F.lit(""))
        return F.concat(F.lit(f"{axis}='"), value, F.lit("'"), hint)

    def label(axis: str, value: Column, domain: tuple[str, ...]) -> Column:
        return F.when(value == "", f"sentiment filled but {axis} blank").when(~value.isin(*domain), wrong(axis, value))

    annotated = (cid != "") & (sent != "")
    labelled = annotated & (sent != "skip")

    def found(level: str, when: Column, message: Column) -> Column:
        return F.when(when & message.isNotNull(), F.struct(F.lit(level).alias("level"), message.alias("message")))

    rows = sheet
    again = F.lit(False)
    if {"file", "line"} <= set(sheet.columns):
        regular = ~F.col("file").contains("retest")
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(regular, cid).orderBy("file", "line")))
        again = regular & (F.col("_k") > 1)
    unknown = F.lit(False)
    if manifest is not None:
        known = manifest.select(F.col("comment_id").alias("_known")).distinct()
        rows = rows.join(known, cid == F.col("_known"), "left")
        unknown = (cid != "") & F.col("_known").isNull()
        if known.isEmpty():
            unknown = F.lit(False)
    checks = F.array(
        found("warning", again, F.lit("comment_id appears twice across batches")),
        found("error", unknown, F.lit("comment_id not in manifest - the cell was probably edited")),
        found("error", F.lit(True), F.when(cid == "", "missing comment_id")),
        found("error", annotated & ~sent.isin(*sentiments), wrong("sentiment", sent)),
        found("warning", annotated & (sent == "skip") & ((dens != "") | (lang != "")), F.lit("sentiment=skip but density/base_lang filled - they will be discarded")),
        found("error", labelled, label("density", dens, densities)),
        found("error", labelled, label("base_lang", lang, languages)),
    )
    place = [c for c in ("file", "line") if c in sheet.columns]
    return rows.select(*place, F.explode(F.array_compact(checks)).alias("f")).select("f.level", *place, "f.message")


def labelled_rows(sheet: DataFrame) -> DataFrame:
    """Rows with an id and a sentiment, their labels as compared; skipped rows without other labels."""
    sent = cell(F.col("sentiment"))
    out = sheet.withColumns({"comment_id": F.trim("comment_id"), "sentiment": sent, "density": F.when(sent == "skip", "").otherwise(cell(F.col("density"))), "base_lang": F.when(sent == "skip", "").otherwise(cell(F.col("base_lang")))})
    return out.where("comment_id <> '' and sentiment <> ''")


def merge(sheets: DataFrame, clean: DataFrame, manifest: DataFrame, sentiments=SENTIMENTS, densities=DENSITIES, languages=LANGUAGES) -> DataFrame:
    """All sheet rows (file, line, ...) with ``outcome``: labelled, repeated, skipped, blank, invalid or unknown.

    The first label of a comment wins.  Labelled rows carry the clean corpus's text and columns, those of its last row (by ``seq``, or by
    value where it has none) if it repeats an id, and the sample and inclusion probability of ``manifest_index``, "" if it isn't there.  Each sheet row stays one row.
    """
    cid, sent, dens, lang = F.trim(F.coalesce("comment_id", F.lit(""))), cell(F.col("sentiment")), cell(F.col("density")), cell(F.col("base_lang"))
    valid = F.col("sentiment").isin(*(s for s in sentiments if s != "skip")) & F.col("density").isin(*densities) & F.col("base_lang").isin(*languages)
    rows = sheets.select("file", "line", cid.alias("comment_id"), sent.alias("sentiment"), dens.alias("density"), lang.alias("base_lang"), F.trim(F.coalesce("notes", F.lit(""))).alias("notes"))
    rows = rows.withColumn("outcome", F.when((F.col("comment_id") == "") | (F.col("sentiment") == ""), "blank").when(F.col("sentiment") == "skip", "skipped").when(~valid, "invalid"))
    carried = ("text", "video_id", "n_tokens", "density_eligible", "screen_bucket")
    last = F.max(F.struct(*(c for c in ("seq",) if c in clean.columns), *carried)).alias("_c")
    corpus = clean.groupBy("comment_id").agg(last).select("comment_id", *(F.col(f"_c.{c}").alias(c) for c in carried), F.lit(True).alias("_clean"))
    joined = rows.join(corpus, "comment_id", "left").withColumn("outcome", F.coalesce("outcome", F.when(F.col("_clean").isNull(), "unknown")))
    firsts = joined.where("outcome is null").groupBy("comment_id").agg(F.min(F.struct("file", "line")).alias("_first"))
    joined = joined.join(firsts, "comment_id", "left").withColumn("outcome", F.coalesce("outcome", F.when(F.struct("file", "line") == F.col("_first"), "labelled").otherwise("repeated")))
    drawn = manifest_index(manifest).select("comment_id", "sample", "inclusion_prob")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("sample", "inclusion_prob")}
    return joined.drop("_clean", "_first").join(drawn, "comment_id", "left").withColumns(blank)


def merge_summary(merged: DataFrame) -> DataFrame:
    """``axis, value, n``: the outcomes of ``merge``, the labels of each axis among the labelled rows, and how many of them density is meant for."""
    kept = F.col("outcome") == "labelled"
    axes = F.array(
        F.struct(F.lit("outcome").alias("axis"), F.col("outcome").alias("value")),
        *(F.when(kept, F.struct(F.lit(a).alias("axis"), F.col(a).alias("value"))) for a in ("sentiment", "density", "base_lang")),
        F.when(kept & F.col("density_eligible"), F.struct(F.lit("eligible").alias("axis"), F.lit("density").alias("value"))),
    )
    return merged.select(F.explode(F.array_compact(axes)).alias("x")).groupBy("x.axis", "x.value").agg(F.count("*").alias("n"))


def answer_summary(accepted: DataFrame) -> DataFrame:
    """``axis, value, n``: confidences and sentiments of accepted answers."""
    return accepted.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in ("confidence", "sentiment")))).alias("x")).groupBy("x.axis", "x.value").agg(F.count("*").alias("n"))


# --- prompts and replies ----------------------------------------------------------------------------


def prompts(sheets: DataFrame, instructions: str, per_prompt: int = 40, include_annotated: bool = False, only: tuple[str, ...] = ()) -> DataFrame:
    """``prompt, n, ids, body`` for rows to annotate, ``per_prompt`` at a time in the order of file and line; of the files ``only``, if any are given."""
    if only:
        sheets = sheets.where(F.col("file").isin(*only))
    todo = sheets.where(F.trim(F.coalesce("comment_id", F.lit(""))) != "")
    if not include_annotated:
        todo = todo.where(F.trim(F.coalesce("sentiment", F.lit(""))) == "")
    number = F.floor((F.row_number().over(Window.orderBy("file", "line", "comment_id")) - 1) / per_prompt) + 1
    item = F.concat(F.lit('{"id": "'), "comment_id", F.lit('", "text": '), flat_json(F.coalesce("text", F.lit(""))), F.lit("}"))
    got = todo.select(number.alias("k"), F.struct("file", "line", F.col("comment_id").alias("id"), item.alias("item")).alias("r")).groupBy("k").agg(F.sort_array(F.collect_list("r")).alias("r"), F.count("*").alias("n"))
    body = F.concat(F.lit(instructions), F.lit("\n## Комментарии ("), F.col("n").cast("string"), F.lit(" штук)\n\n"), F.array_join("r.item", "\n"), F.lit("\n\nВерни JSON-массив из ровно "), F.col("n").cast("string"), F.lit(" объектов.\n"))
    name = F.concat(F.lit("prompt_"), F.when(F.col("k") < 100, F.lpad(F.col("k").cast("string"), 2, "0")).otherwise(F.col("k").cast("string")))
    return got.select(name.alias("prompt"), "n", F.col("r.id").alias("ids"), body.alias("body"))


_ANSWER = "array<struct<id:string,sentiment:string,base_lang:string,confidence:string,note:string>>"


def parse_replies(replies: DataFrame) -> DataFrame:
    """``reply, answers, error`` of replies (``reply``, ``raw``): a code fence is stripped, and an array amid prose recovered."""
    raw = F.regexp_replace(F.col("raw"), r"(?U)^\s+|\s+$", "")
    fenced = F.when(raw.startswith("```"), F.regexp_replace(F.regexp_replace(raw, r"(?U)^```[a-zA-Z]*\s*", ""), r"(?U)\s*```$", "")).otherwise(raw)
    found = F.when(fenced.startswith("["), fenced).otherwise(F.regexp_extract(fenced, r"(?s)\[.*\]", 0))
    out = replies.withColumn("_a", found).withColumn("answers", F.when(F.col("_a") != "", F.from_json("_a", _ANSWER)))
    error = F.when(F.col("_a") == "", "no JSON array found").when(F.col("answers").isNull(), "invalid JSON")
    return out.select("reply", "answers", error.alias("error"))


def ingest(replies: DataFrame, index: DataFrame, sentiments=SENTIMENTS, languages=LANGUAGES) -> tuple[DataFrame, DataFrame]:
    """(accepted, problems) of model replies against the prompt index (``prompt, ids``).

    accepted: ``reply, pos, id, sentiment, base_lang, confidence, note``; within a reply the first valid answer of an id wins, and
    over replies the last.  problems: ``reply, problem``.
    """
    parsed = parse_replies(replies).withColumn("prompt", F.regexp_replace("reply", "^reply_", "prompt_"))
    known = parsed.join(index.select("prompt", "ids"), "prompt", "left")
    whole = known.select("reply", F.when(F.col("ids").isNull(), "no matching prompt").otherwise(F.col("error")).alias("problem")).where("problem is not null")
    usable = known.where("ids is not null and error is null")
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rec = usable.select("reply", "ids", F.posexplode("answers").alias("pos", "r")).select(
        "reply",
        "ids",
        "pos",
        F.col("r").isNull().alias("no_object"),
        trimmed("r.id").alias("id"),
        cell(F.col("r.sentiment")).alias("sentiment"),
        cell(F.col("r.base_lang")).alias("base_lang"),
        cell(F.coalesce("r.confidence", F.lit("high"))).alias("confidence"),
        trimmed("r.note").alias("note"),
    )
    skip = F.col("sentiment") == "skip"
    wrong = (
        F.when(F.col("no_object"), F.lit("not an object"))
        .when(F.col("id") == "", F.lit("missing id"))
        .when(~F.array_contains("ids", F.col("id")), F.concat(F.lit("id "), F.left("id", F.lit(24)), F.lit(" was not in this prompt")))
        .when(~F.col("sentiment").isin(*sentiments), F.concat(F.left("id", F.lit(12)), F.lit(": sentiment '"), "sentiment", F.lit("'")))
        .when(~skip & ~F.col("base_lang").isin(*languages), F.concat(F.left("id", F.lit(12)), F.lit(": base_lang '"), "base_lang", F.lit("'")))
    )
    checked = rec.withColumns({"problem": wrong, "base_lang": F.when(skip, "").otherwise(F.col("base_lang")), "confidence": F.when(F.col("confidence").isin("high", "low"), F.col("confidence")).otherwise("low")})
    valid = checked.where("problem is null")
    first = valid.withColumn("_k", F.row_number().over(Window.partitionBy("reply", "id").orderBy("pos")))
    per_reply = first.where("_k = 1").drop("_k", "problem", "no_object", "ids")
    twice = first.where("_k > 1").select("reply", F.concat(F.lit("id "), F.left("id", F.lit(24)), F.lit(" answered twice")).alias("problem"))
    seen = per_reply.groupBy("reply").agg(F.count("*").alias("got"))
    missing = usable.join(seen, "reply", "left").select("reply", (F.size(F.array_distinct("ids")) - F.coalesce("got", F.lit(0))).alias("m"), F.size(F.array_distinct("ids")).alias("of"))
    unanswered = missing.where("m > 0").select("reply", F.concat(F.col("m").cast("string"), F.lit(" of "), F.col("of").cast("string"), F.lit(" comments unanswered")).alias("problem"))
    problems = whole.unionByName(checked.where("problem is not null").select("reply", "problem")).unionByName(twice).unionByName(unanswered)
    last = per_reply.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("reply")))).where("_k = 1").drop("_k")
    return last, problems


def apply_answers(sheets: DataFrame, accepted: DataFrame) -> DataFrame:
    """Sheets with accepted answers where the sentiment is blank; density stays for the measure, a note only replaces if there is one."""
    a = accepted.select(F.col("id").alias("_id"), F.col("sentiment").alias("_s"), F.col("base_lang").alias("_l"), F.col("note").alias("_n"))
    joined = sheets.join(a, F.trim("comment_id") == F.col("_id"), "left")
    write = F.col("_id").isNotNull() & (F.trim(F.coalesce("sentiment", F.lit(""))) == "")
    new = {"sentiment": F.when(write, F.col("_s")).otherwise(F.col("sentiment")), "base_lang": F.when(write, F.col("_l")).otherwise(F.col("base_lang")), "notes": F.when(write & (F.col("_n") != ""), F.col("_n")).otherwise(F.col("notes"))}
    return joined.withColumns(new).select(*sheets.columns)


def audit_queue(checked: DataFrame, sheets: DataFrame) -> DataFrame:
    """Rows for a human to audit, with the sheet's text, "" if no sheet has it and the least if several do."""
    texts = sheets.groupBy(F.trim("comment_id").alias("id")).agg(F.min("text").alias("text"))
    blank = {c: F.lit("") for c in ("human_sentiment", "human_base_lang", "human_note")}
    return checked.join(texts, "id", "left").select(F.col("id").alias("comment_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("sentiment").alias("llm_sentiment"), F.col("base_lang").alias("llm_base_lang"), F.col("confidence").alias("llm_confidence"), F.col("note").alias("llm_note")).withColumns(blank)
