"""Text normalisation as column expressions: nothing here leaves the JVM.

Patterns use ``(?U)`` where white space is meant in the Unicode sense, and letters, digits and the
underscore by property, as the ASCII classes of Java's regular expressions differ on both.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .profiles import KAZAKH_RUSSIAN, LanguagePair

URL = r"https?://\S+|www\.\S+"
MENTION = r"@[\p{L}\p{N}_.Ѐ-ӿ-]+"
CLOCK = r"\b\d{1,2}:\d{2}(?::\d{2})?\b"
MAX_CHARS = 1500
MIN_CORPUS_TOKENS = 3
MIN_DENSITY_TOKENS = 5


def squeeze(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def anonymize(text: Column) -> Column:
    """Addresses and mentions as placeholders, then white space squeezed."""
    text = F.regexp_replace(text, f"(?U){URL}", "<URL>")
    return squeeze(F.regexp_replace(text, MENTION, "<USER>"))


def collapse_repeats(text: Column) -> Column:
    """Runs of four or more equal characters as three."""
    return F.regexp_replace(text, r"(.)\1{3,}", "$1$1$1")


def words(text: Column, pair: LanguagePair = KAZAKH_RUSSIAN) -> Column:
    """The words, each in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(pair.token), F.lit(0)), F.lower)


def tokenize(text: Column, pair: LanguagePair = KAZAKH_RUSSIAN) -> Column:
    """The words of the text in lower case; differs from ``words`` where lower-casing changes what a letter is."""
    return F.regexp_extract_all(F.lower(text), F.lit(pair.token), F.lit(0))


def n_tokens(text: Column, pair: LanguagePair = KAZAKH_RUSSIAN) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pair.token), F.lit(0))).cast("long")


def norm_key(text: Column) -> Column:
    """MD5 of the lower-cased text without punctuation: the key of exact duplicates."""
    return F.md5(squeeze(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_\s]", "")).cast("binary"))


def token_key(text: Column, pair: LanguagePair = KAZAKH_RUSSIAN, least: int = 3) -> Column:
    """MD5 of the sorted words, whatever their order was; null under ``least`` words."""
    found = words(text, pair)
    return F.when(F.size(found) >= least, F.md5(F.array_join(F.sort_array(found), " ").cast("binary")))


def script_of(text: Column, pair: LanguagePair = KAZAKH_RUSSIAN) -> Column:
    main, other = pair.script_names
    return F.when(text.rlike(f"[{pair.main_class}]"), main).when(text.rlike(f"[{pair.other_class}]"), other).otherwise("none")


def is_promo(text: Column, pair: LanguagePair = KAZAKH_RUSSIAN) -> Column:
    return text.rlike("(?iu)" + "|".join(pair.promo)) if pair.promo else F.lit(False)


def classify_row(text: Column, pair: LanguagePair = KAZAKH_RUSSIAN, max_chars: int = MAX_CHARS, least: int = MIN_CORPUS_TOKENS, density_least: int = MIN_DENSITY_TOKENS) -> Column:
    """struct(status, reason): the first rule that holds decides."""
    tokens, script = n_tokens(text, pair), script_of(text, pair)

    def outcome(status: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    return (
        F.when(F.length(text) > max_chars, outcome("drop", "too_long"))
        .when(script == "none", outcome("drop", "no_letters"))
        .when(text.rlike(CLOCK) & (n_tokens(F.regexp_replace(text, CLOCK, " "), pair) < least), outcome("drop", "timestamp_only"))
        .when((text.rlike(f"(?U){URL}") | text.contains("<URL>")) & is_promo(text, pair), outcome("drop", "promo"))
        .when(tokens < least, outcome("drop", "too_few_tokens"))
        .when(script == pair.script_names[1], outcome("romanized", f"{pair.script_names[1]}_script"))
        .when(tokens < density_least, outcome("too_short", "below_density_threshold"))
        .otherwise(outcome("ok", ""))
    )


def is_usable(text: Column, pair: LanguagePair = KAZAKH_RUSSIAN) -> Column:
    """The looser rule of a guideline pilot."""
    return F.length(text).between(3, 500) & text.rlike(f"[{pair.main_class}]") & ~(text.contains("<URL>") & (F.length(text) < 20))


def deaccent(word: Column, pair: LanguagePair = KAZAKH_RUSSIAN) -> Column:
    return F.translate(word, *pair.accents)


def has_any(text: Column, letters: str) -> Column:
    return text.rlike(f"[{letters}]") if letters else F.lit(False)


def cell(value: Column) -> Column:
    """A label cell as it is compared: never null, trimmed, in lower case."""
    return F.lower(squeeze(F.coalesce(value, F.lit(""))))


def stratum(sentiment: Column, density: Column) -> Column:
    return F.concat_ws("|", sentiment, density)


def density_bucket(a: Column, b: Column, empty: str = "unknown") -> Column:
    """Bucket of two counts by the share of the smaller."""
    share = F.least(a, b) / (a + b)
    return F.when(a + b == 0, empty).when((a == 0) | (b == 0), "mono").when(share <= 0.2, "low").when(share <= 0.4, "med").otherwise("high")


def flat_json(text: Column) -> Column:
    """The text on one line, as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(squeeze(text).alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)


def wrap(text: Column, width: int) -> Column:
    """Lines of whole words, each as long as ``width`` allows; a longer word has a line of its own."""
    start = F.struct(F.lit("").alias("line"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, word: Column) -> Column:
        joined = F.when(state.line == "", word).otherwise(F.concat_ws(" ", state.line, word))
        full = (state.line != "") & (F.length(joined) > width)
        return F.struct(F.when(full, word).otherwise(joined).alias("line"), F.when(full, F.array_append(state.out, state.line)).otherwise(state.out).alias("out"))

    words_ = F.filter(F.split(squeeze(text), " "), lambda w: w != "")
    return F.aggregate(words_, start, step, lambda s: F.when(s.line == "", s.out).otherwise(F.array_append(s.out, s.line)))


def register(spark: SparkSession, pair: LanguagePair = KAZAKH_RUSSIAN) -> None:
    """SQL functions of the session: anonymize, norm_key, token_key, script_of and density_bucket.  They are SQL bodies, which the planner inlines."""
    token = pair.token
    bodies = {
        "anonymize(t STRING) RETURNS STRING": f"trim(regexp_replace(regexp_replace(regexp_replace(t, r'(?U){URL}', '<URL>'), r'{MENTION}', '<USER>'), r'(?U)\\s+', ' '))",
        "norm_key(t STRING) RETURNS STRING": r"md5(trim(regexp_replace(regexp_replace(lower(t), r'(?U)[^\p{L}\p{N}_\s]', ''), r'(?U)\s+', ' ')))",
        "token_key(t STRING) RETURNS STRING": f"CASE WHEN size(regexp_extract_all(t, '{token}', 0)) >= 3 THEN md5(array_join(array_sort(transform(regexp_extract_all(t, '{token}', 0), w -> lower(w))), ' ')) END",
        "script_of(t STRING) RETURNS STRING": f"CASE WHEN t RLIKE '[{pair.main_class}]' THEN '{pair.script_names[0]}' WHEN t RLIKE '[{pair.other_class}]' THEN '{pair.script_names[1]}' ELSE 'none' END",
        "density_bucket(a BIGINT, b BIGINT) RETURNS STRING": "CASE WHEN a + b = 0 THEN 'unknown' WHEN a = 0 OR b = 0 THEN 'mono' WHEN least(a, b) / (a + b) <= 0.2 THEN 'low' WHEN least(a, b) / (a + b) <= 0.4 THEN 'med' ELSE 'high' END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
