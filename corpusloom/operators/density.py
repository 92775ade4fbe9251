"""Mixing density: a bootstrapped lexicon, two character models, and each text's minority share.

Words are scored once for each distinct form and joined back to their occurrences.  The lexicon and
the n-gram counts are tables, so they may outgrow a broadcast; the planner decides by their size.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from corpusloom.functions import text as T
from corpusloom.functions.profiles import KAZAKH_RUSSIAN, LanguagePair
from corpusloom.storage import delete_shared, materialise

SMOOTH = 0.5
MIN_FREQ = 3
LLR_MARGIN = 0.35
MOST_WEIGHT = 50
MIN_DOCUMENTS = 100
MIN_SEEDS = 200
#: Words whose languages are broadcast, and texts that a worker unpacks at once.
MOST_COMMON, TEXTS_AT_ONCE = 200_000, 32


def document_sides(rows: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN) -> DataFrame:
    """``seq, w, side``: each text's words, and the language that it is confidently written in, if any."""
    marked_a = F.size(F.filter("w", lambda x: T.has_any(x, pair.letters_a)))
    marked_b = F.size(F.filter("w", lambda x: x.isin(*pair.func_b) | T.has_any(x, pair.letters_b)))
    listed = rows.select("seq", T.words(F.coalesce("text", F.lit("")), pair).alias("w")).withColumns({"_a": marked_a, "_b": marked_b, "_n": F.size("w")})
    side = F.when(F.col("_n") < 4, None).when((F.col("_a") >= 2) & (F.col("_a") / F.col("_n") >= 0.25) & (F.col("_b") == 0), pair.a).when((F.col("_a") == 0) & (F.col("_b") >= 2), pair.b)
    return listed.select("seq", "w", side.alias("side"))


def word_frequencies(sided: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN) -> DataFrame:
    """``word, n_a, n_b, n``: occurrences in the texts of each side and in all."""
    return sided.select("side", F.explode("w").alias("word")).groupBy("word").agg(F.count_if(F.col("side") == pair.a).alias("n_a"), F.count_if(F.col("side") == pair.b).alias("n_b"), F.count("*").alias("n"))


def seed_words(freq: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN) -> DataFrame:
    """``word, lang, n``: words whose spread over the two sides settles them, after the overrides.

    The letter rule overrides the ratio, and the list of shared words both.
    """
    total = freq.agg(F.greatest(F.sum("n_a"), F.lit(1)).alias("_ta"), F.greatest(F.sum("n_b"), F.lit(1)).alias("_tb"))
    a, b = F.col("n_a") / F.col("_ta"), F.col("n_b") / F.col("_tb")
    p, n = F.try_divide(a, a + b), F.col("n_a") + F.col("n_b")
    ratio = F.when(F.col("word").isin(*pair.stop_both) | (n < 2), None).when(p.between(0.25, 0.75) & (n >= 8), "shared").when(p >= 0.9, pair.a).when(p <= 0.1, pair.b)
    lang = F.when(F.col("word").isin(*pair.shared_seed), "shared").when(T.has_any(F.col("word"), pair.letters_a), pair.a).otherwise(ratio)
    return freq.crossJoin(F.broadcast(total)).select("word", lang.alias("lang"), "n").where("lang is not null")  # one row of totals


def _positions(words: DataFrame, *keep: str) -> DataFrame:
    """Each word's trigrams over ``^^word$`` with their contexts."""
    padded = words.select("word", *keep, F.concat(F.lit("^^"), "word", F.lit("$")).alias("s"))
    at = padded.select("word", *keep, "s", F.explode(F.expr("sequence(1, length(s) - 2)")).alias("i"))
    return at.select("word", *keep, F.col("s").substr(F.col("i"), F.lit(2)).alias("ctx"), F.col("s").substr(F.col("i"), F.lit(3)).alias("gram"))


def char_model(seeds: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN) -> DataFrame:
    """``kind, key, a, b``: weighted counts of contexts and n-grams in each language, and its alphabet's size.

    ``kind`` is ``ctx``, ``gram`` or ``alphabet`` (one row, with an empty key).
    """
    own = seeds.where(F.col("lang").isin(pair.a, pair.b)).select("word", "lang", F.least("n", F.lit(MOST_WEIGHT)).alias("weight"))
    at = _positions(own, "lang", "weight")

    def weight(code: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("lang") == code, F.col("weight"))), F.lit(0))

    counted = [at.select(F.lit(k).alias("kind"), F.col(k).alias("key"), "lang", "weight").groupBy("kind", "key").agg(weight(pair.a).alias("a"), weight(pair.b).alias("b")) for k in ("ctx", "gram")]
    letters = own.select("lang", F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    alphabet = letters.agg(F.lit("alphabet").alias("kind"), F.lit("").alias("key"), F.count_if(F.col("lang") == pair.a).alias("a"), F.count_if(F.col("lang") == pair.b).alias("b"))
    return counted[0].unionByName(counted[1]).unionByName(alphabet)


def word_llr(words: DataFrame, model: DataFrame) -> DataFrame:
    """``word, llr``: mean log-probability under language a less that under b; for a table of distinct words."""
    at = _positions(words.select("word"))
    grams = model.where("kind = 'gram'").select(F.col("key").alias("gram"), F.col("a").alias("ga"), F.col("b").alias("gb"))
    contexts = model.where("kind = 'ctx'").select(F.col("key").alias("ctx"), F.col("a").alias("ca"), F.col("b").alias("cb"))
    size = model.where("kind = 'alphabet'").select(F.greatest("a", F.lit(1)).alias("va"), F.greatest("b", F.lit(1)).alias("vb"))
    joined = at.join(grams, "gram", "left").join(contexts, "ctx", "left").crossJoin(F.broadcast(size))  # one row

    def log(g: str, c: str, v: str) -> Column:
        return F.log((F.coalesce(g, F.lit(0)) + SMOOTH) / (F.coalesce(c, F.lit(0)) + SMOOTH * F.col(v)))

    return joined.groupBy("word").agg((F.avg(log("ga", "ca", "va")) - F.avg(log("gb", "cb", "vb"))).alias("llr"))


def by_llr(llr: Column, pair: LanguagePair) -> Column:
    return F.when(llr > LLR_MARGIN, pair.a).when(llr < -LLR_MARGIN, pair.b).otherwise("ambiguous")


@dataclass
class DensityModel:
    """``lexicon`` (word, lang, confident), ``chars`` as of ``char_model``, ``stripped`` (form, collision).

    ``frequencies`` (word, n), if known, only say which words are worth a broadcast; results don't depend on them.
    """

    lexicon: DataFrame
    chars: DataFrame
    stripped: DataFrame
    pair: LanguagePair = KAZAKH_RUSSIAN
    frequencies: DataFrame | None = None

    def save(self, folder: str) -> None:
        for name in ("lexicon", "chars", "stripped"):
            getattr(self, name).write.parquet(f"{folder}/{name}")
        spark = self.lexicon.sparkSession
        params = {"ngram": 3, "smooth": SMOOTH, "min_freq": MIN_FREQ, "llr_margin": LLR_MARGIN}
        spark.createDataFrame([params]).write.parquet(f"{folder}/params")

    def release(self) -> None:
        """Delete the tables that ``assemble`` has stored; the model is of no use after that."""
        for table in (self.lexicon, self.chars, self.stripped, self.frequencies):
            if path := getattr(table, "shared_path", None):
                delete_shared(table.sparkSession, path)

    @classmethod
    def load(cls, spark, folder: str, pair: LanguagePair = KAZAKH_RUSSIAN) -> DensityModel:
        return cls(*(spark.read.parquet(f"{folder}/{n}") for n in ("lexicon", "chars", "stripped")), pair)


def stripped_forms(lexicon: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN) -> DataFrame:
    """``form, collision``: what words with letters of language a look like without accents; whether b has that word."""
    forms = lexicon.where((F.col("lang") == pair.a) & T.has_any(F.col("word"), pair.letters_a)).select(T.deaccent(F.col("word"), pair).alias("form")).distinct()
    taken = lexicon.where(F.col("lang") == pair.b).select(F.col("word").alias("form"), F.lit(True).alias("_b"))
    return forms.join(taken, "form", "left").select("form", F.coalesce("_b", F.lit(False)).alias("collision"))


def build_lexicon(rows: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN, min_documents: int = MIN_DOCUMENTS, min_seeds: int = MIN_SEEDS) -> DensityModel:
    """Fit the lexicon and models on ``rows`` (seq, text); raises ValueError if there is too little to learn from."""
    sided = document_sides(rows, pair)
    sizes = {r.side: r["count"] for r in sided.groupBy("side").count().collect()}  # three rows
    if min(sizes.get(pair.a, 0), sizes.get(pair.b, 0)) < min_documents:
        raise ValueError("too few monolingual documents to bootstrap from")
    freq = materialise(word_frequencies(sided, pair), "frequencies")
    seeds = seed_words(freq, pair)
    counts = {r.lang: r["count"] for r in seeds.groupBy("lang").count().collect()}
    if min(counts.get(pair.a, 0), counts.get(pair.b, 0)) < min_seeds:
        raise ValueError("not enough seed words to fit the models")
    return assemble(freq, pair)


def assemble(freq: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN) -> DensityModel:
    """The model of a table of word frequencies.

    Its tables grow with the vocabulary, not with the corpus, and are stored, so that the texts are read once for them.
    """
    freq = materialise(freq, "frequencies")
    seeds = materialise(seed_words(freq, pair), "seeds")
    chars = materialise(char_model(seeds, pair), "characters")
    lexicon = materialise(resolve(freq, seeds, chars, pair), "lexicon")
    return DensityModel(lexicon, chars, materialise(stripped_forms(lexicon, pair), "stripped"), pair, freq)


def resolve(freq: DataFrame, seeds: DataFrame, chars: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN) -> DataFrame:
    """``word, lang, confident``: the seeds, and frequent other words by the character models."""
    open_words = freq.where((F.col("n") >= MIN_FREQ) & ~F.col("word").isin(*pair.stop_both)).join(seeds.select("word"), "word", "left_anti")
    guessed = word_llr(open_words, chars).select("word", by_llr(F.col("llr"), pair).alias("lang"), F.lit(False).alias("confident"))
    return seeds.select("word", "lang", F.lit(True).alias("confident")).unionByName(guessed)


def seed_rule(word: Column, pair: LanguagePair) -> Column:
    return (
        F.when(word.isin(*pair.stop_both), None)
        .when(T.has_any(word, pair.letters_a) | word.isin(*pair.func_a), pair.a)
        .when(T.has_any(word, pair.letters_b) | word.isin(*pair.func_b), pair.b)
    )


def word_languages(words: DataFrame, model: DensityModel) -> DataFrame:
    """``word, lang`` of a table of distinct words: evidence first, then stripped forms, then guesses."""
    pair = model.pair
    known = words.join(model.lexicon, "word", "left")
    eligible = (F.length("word") >= 4) & ~F.col("word").isin(*pair.func_b) & ~T.has_any(F.col("word"), pair.letters_a)
    formed = known.withColumn("form", F.when(eligible, T.deaccent(F.col("word"), pair))).join(model.stripped, "form", "left")
    settled = (
        F.when(F.col("confident"), F.col("lang"))
        .when(F.col("collision"), "ambiguous")
        .when(F.col("collision").isNotNull(), pair.a)
        .when(F.col("lang").isNotNull(), F.col("lang"))
        .when(F.col("word").isin(*pair.stop_both), "ambiguous")
        .otherwise(seed_rule(F.col("word"), pair))
    )
    first = formed.select("word", settled.alias("lang"))
    rest = word_llr(first.where("lang is null"), model.chars).select("word", by_llr(F.col("llr"), pair).alias("lang"))
    return first.where("lang is not null").unionByName(rest)


def _counted(languages, a: str, b: str):
    """Batches (seq, w) to what common words, of a broadcast Arrow table (word, lang), say of each text, and its other words: ``word, c, first``."""

    def run(batches):
        known = dict(zip(languages.value.column("word").to_pylist(), languages.value.column("lang").to_pylist()))
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
                piece = batch.slice(first, TEXTS_AT_ONCE)
                out: list[list] = [[] for _ in range(8)]
                for words in piece.column("w").to_pylist():
                    at: dict[str, int] = {}
                    for pos, w in enumerate(words):
                        at.setdefault(w, pos)
                    n = Counter(words)
                    votes, opening, rare = {a: 0, b: 0, "shared": 0}, (None, None), []
                    for w, pos in at.items():  # by first place
                        if (lang := known.get(w)) is None:
                            rare.append(w)
                        elif lang in votes:
                            votes[lang] += n[w]
                            if opening[0] is None and lang != "shared":
                                opening = (pos, lang)
                    for x, value in zip(out, (*votes.values(), *opening, rare, [n[w] for w in rare], [at[w] for w in rare])):
                        x.append(value)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.record_batch([piece.column("seq"), *(pa.array(x, k) for x, k in zip(out, kinds))], ["seq", "a", "b", "shared", "pos", "lang", "word", "c", "first"])

    return run


def measure(rows: DataFrame, model: DensityModel) -> DataFrame:
    """``rows`` with ``a, b, shared, counted, minority_share, density, base_lang``.

    The base language is settled by unambiguous words, a tie by the first of them; shared words then count for
    it.  A text without evidence has density and base language "" and counts 0.

    The languages of the model's ``MOST_COMMON`` most frequent words are broadcast and counted where the text is; only other words are
    shuffled, once for each text that they are in.  A text's sums, with its other words, are stored.
    """
    pair = model.pair
    candidates = model.lexicon.select("word") if model.frequencies is None else model.frequencies.orderBy(F.desc("n"), "word").select("word")
    common = word_languages(materialise(candidates.limit(MOST_COMMON), "common"), model).select("word", "lang").toArrow()
    listed = rows.select("seq", T.words(F.coalesce("text", F.lit("")), pair).alias("w"))
    schema = StructType([listed.schema["seq"], *(StructField(c, LongType()) for c in ("a", "b", "shared", "pos")), StructField("lang", StringType()), *(StructField(c, ArrayType(t)) for c, t in (("word", StringType()), ("c", LongType()), ("first", LongType())))])
    counted = materialise(listed.mapInArrow(_counted(rows.sparkSession.sparkContext.broadcast(common), pair.a, pair.b), schema), "counted")
    rare = counted.select("seq", F.explode(F.arrays_zip("word", "c", "first")).alias("_r")).select("seq", F.col("_r.word").alias("word"), F.col("_r.c").alias("c"), F.col("_r.first").alias("pos"))
    lang = word_languages(rare.select("word").distinct(), model)
    code = F.col("lang")
    each = [F.when(code == k, F.col("c")).alias(n) for k, n in ((pair.a, "a"), (pair.b, "b"), ("shared", "shared"))]
    tagged = rare.join(lang, "word").where(code.isin(pair.a, pair.b, "shared"))
    opens = F.when(code.isin(pair.a, pair.b), F.struct("pos", "lang")).alias("opening")
    parts = counted.select("seq", "a", "b", "shared", opens).unionByName(tagged.select("seq", *each, opens))
    sums = parts.groupBy("seq").agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("a", "b", "shared")), F.min("opening").lang.alias("opening"))
    joined = rows.join(sums, "seq", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("a", "b", "shared")})
    return joined.withColumns(folded(pair)).drop("opening")


def folded(pair: LanguagePair) -> dict[str, Column]:
    """The measure's columns from ``a, b, shared, opening``; counts a and b are those after folding shared words in."""
    a, b, shared = F.col("a"), F.col("b"), F.col("shared")
    none = (a == 0) & (b == 0)
    base = F.when(none, "").when(a > b, pair.a).when(b > a, pair.b).otherwise(F.col("opening"))
    whole_a, whole_b = F.when(base == pair.a, a + shared).otherwise(a), F.when(base == pair.b, b + shared).otherwise(b)
    share = F.coalesce(F.try_divide(F.least(whole_a, whole_b), whole_a + whole_b), F.lit(0.0))
    return {
        "counted": F.when(none, 0).otherwise(whole_a + whole_b).cast("long"),
        "minority_share": F.when(none, 0.0).otherwise(F.bround(share, 4)),
        "density": F.when(none, "").otherwise(T.density_bucket(whole_a, whole_b)),
        "base_lang": base,
        "a": whole_a,
        "b": whole_b,
    }


def fill_sheet(sheet: DataFrame, measured: DataFrame) -> DataFrame:
    """A sheet with density written in, and the base language where it is blank; skipped and unmeasured rows stay.

    ``measured`` has ``comment_id`` and the measure's columns.
    """
    least = F.min(F.struct("density", "base_lang"))  # of measures that disagree
    m = measured.where("density <> ''").groupBy("comment_id").agg(least.alias("_m")).select("comment_id", F.col("_m.density").alias("_d"), F.col("_m.base_lang").alias("_l"))
    joined = sheet.join(m, "comment_id", "left")
    write = F.col("_d").isNotNull() & (F.trim(F.coalesce("sentiment", F.lit(""))) != "skip")
    blank = F.trim(F.coalesce("base_lang", F.lit(""))) == ""
    return joined.withColumns({"density": F.when(write, F.col("_d")).otherwise(F.col("density")), "base_lang": F.when(write & blank, F.col("_l")).otherwise(F.col("base_lang"))}).select(*sheet.columns)
