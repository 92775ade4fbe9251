"""Text representations: word and character TF-IDF, pooled vectors, and a registry of them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from corpusloom.functions import text as T
from corpusloom.functions.profiles import KAZAKH_RUSSIAN, LanguagePair
from corpusloom.storage import delete_shared, materialise

WORD_FEATURES = 50_000
CHAR_FEATURES = 100_000
MIN_DF = 2


def word_terms(text: Column, pair: LanguagePair = KAZAKH_RUSSIAN) -> Column:
    """Words and pairs of neighbouring words."""
    w = T.tokenize(text, pair)
    return F.when(F.size(w) > 1, F.concat(w, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.concat_ws(" ", x, y)))).otherwise(w)


def char_terms(text: Column) -> Column:
    """Strings of three to five characters inside words padded with a space; a shorter padded word counts once itself."""
    padded = F.transform(F.filter(F.split(T.squeeze(F.lower(text)), " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column) -> Column:
        def of(n: int) -> Column:
            return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: w.substr(i, F.lit(n))))

        # Once a padded word is no longer than n, larger n repeat nothing: it stands once, whole.
        empty = F.array().cast("array<string>")
        return F.when(F.length(w) <= 3, F.array(w)).otherwise(F.concat(of(3), F.coalesce(of(4), empty), F.when(F.length(w) >= 5, of(5)).otherwise(empty)))

    return F.flatten(F.transform(padded, grams))


def word_units(words: list[str]) -> list[str]:
    """``word_terms`` of a text's words, in Python."""
    return words + [f"{x} {y}" for x, y in zip(words, words[1:])]


def word_grams(word: str) -> list[str]:
    """``char_terms`` of one word, in Python."""
    w = f" {word} "
    return [w] if len(w) <= 3 else [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]


#: Terms that a worker numbers before it hands their counts on, units whose grams it remembers, rows or numbers that it gathers, and texts it unpacks at once.
MOST_TERMS, MOST_UNITS, MOST_ROWS, TEXTS_AT_ONCE = 300_000, 100_000, 200_000, 32


def _bags(rows: list[list[list[str]]], number: dict[str, int], cache: dict, units, grams, grow: bool):
    """(numbers, counts) of each row's terms.  Terms without a number get one with ``grow``, and are left out without; numbers ascend then."""
    for texts in rows:
        counted = Counter(u for t in texts for u in units([w for w in t if w]))
        if grams is None:
            own = np.fromiter((number.setdefault(u, len(number)) for u in counted) if grow else (number.get(u, -1) for u in counted), np.int64, len(counted))
            tf = np.fromiter(counted.values(), np.int64, len(counted))
            if not grow:
                order = np.argsort(own)[np.count_nonzero(own < 0) :]
                own, tf = own[order], tf[order]
            yield own, tf
            continue
        found = [np.zeros(0, np.int64)]
        for u in counted:
            if (at := cache.get(u)) is None:
                terms = grams(u)
                at = np.array([number.setdefault(g, len(number)) for g in terms] if grow else [k for g in terms if (k := number.get(g)) is not None], np.int64)
                if len(cache) < MOST_UNITS:
                    cache[u] = at
            found.append(at)
        times = np.repeat(np.array([0, *counted.values()], np.int64), list(map(len, found)))
        unique, where = np.unique(np.concatenate(found), return_inverse=True)
        yield unique, np.bincount(where, times, len(unique)).astype(np.int64)


def _seen(units, grams):
    """Batches (pieces, part) to ``term, part, df, total``, added up over as many texts as ``MOST_TERMS`` allows."""

    def run(batches):
        number: dict[str, int] = {}
        cache: dict = {}
        sums: dict[int, list] = {}
        gathered: dict[int, list] = {}
        size = 0

        def add():
            for part, lists in gathered.items():
                at, tf = (np.concatenate(x) for x in zip(*lists))
                new = np.bincount(at, minlength=len(number)), np.bincount(at, tf, len(number)).astype(np.int64)
                old = sums.get(part, (np.zeros(0, np.int64),) * 2)
                sums[part] = [y + np.pad(x, (0, len(y) - len(x))) for x, y in zip(old, new)]
            gathered.clear()

        def out():
            names = pa.array(list(number), pa.string())
            for part, (df, total) in sums.items():
                for at in np.array_split(np.flatnonzero(df), max(1, len(df) // MOST_ROWS)):
                    yield pa.record_batch([names.take(pa.array(at)), pa.array(np.full(len(at), part)), pa.array(df[at]), pa.array(total[at])], ["term", "part", "df", "total"])
            for x in (number, cache, sums):
                x.clear()

        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
                piece = batch.slice(first, TEXTS_AT_ONCE)
                for part, bag in zip(piece.column("part").to_pylist(), _bags(piece.column("pieces").to_pylist(), number, cache, units, grams, True)):
                    gathered.setdefault(part, []).append(bag)
                    size += len(bag[0])
                if size > 20 * MOST_ROWS or len(number) > MOST_TERMS:
                    add()
                    size = 0
                if len(number) > MOST_TERMS:
                    yield from out()
        add()
        yield from out()

    return run


def _weighted(units, grams, vocabulary, key: str):
    """Batches (key, pieces) to ``key, term, weight``, rows of a text of unit length.  ``vocabulary``: a broadcast Arrow table (term, idf)."""

    def run(batches):
        terms, idf = vocabulary.value.column("term").combine_chunks(), vocabulary.value.column("idf").to_numpy()
        number, cache = {t: k for k, t in enumerate(terms.to_pylist())}, {}

        def out():
            at, rows, weights = (np.concatenate(x) for x in zip(*found))
            return pa.record_batch([keys.take(pa.array(rows)), terms.take(pa.array(at)), pa.array(weights)], [key, "term", "weight"])

        for batch in batches:
            keys, found, size = batch.column(key), [], 0
            for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
                for row, (at, tf) in enumerate(_bags(batch.column("pieces").slice(first, TEXTS_AT_ONCE).to_pylist(), number, cache, units, grams, False), first):
                    w = (1 + np.log(tf)) * idf[at]
                    found.append((at, np.full(len(at), row), w / np.sqrt(w @ w) if len(w) else w))
                    size += len(at)
                if size > MOST_ROWS:
                    yield out()
                    found, size = [], 0
            if found:
                yield out()

    return run


def _numbered(units, grams, vocabulary, keep: tuple[str, ...]):
    """Batches (keep, pieces) to ``keep, at, tf``: the numbers of each text's known terms, ascending, and their counts."""

    def run(batches):
        number, cache = {t: k for k, t in enumerate(vocabulary.value.column("term").to_pylist())}, {}
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
                piece = batch.slice(first, TEXTS_AT_ONCE)
                bags = list(_bags(piece.column("pieces").to_pylist(), number, cache, units, grams, False))
                yield pa.record_batch([*map(piece.column, keep), *(pa.array([x[k] for x in bags], pa.list_(pa.int32())) for k in (0, 1))], [*keep, "at", "tf"])

    return run


class Tfidf:
    """Sublinear TF-IDF with unit rows: ``fit`` learns the vocabulary, ``transform`` gives (doc, term, weight) rows.

    A term needs ``min_df`` documents; the ``max_features`` most frequent remain, ties by name.  A text's terms are counted where the text is:
    rows of text and term are never shuffled or stored, only texts, by their key, and each term's sums.  The vocabulary, bounded by
    ``max_features`` rows of two columns, is broadcast.
    """

    #: In Python: a text's pieces to units, and a unit to terms; by default the pieces are the terms.
    units = staticmethod(list)
    grams = None

    def __init__(self, terms: Callable[[Column], Column], max_features: int, min_df: int = MIN_DF):
        self.terms, self.max_features, self.min_df = terms, max_features, min_df
        self.vocabulary: DataFrame | None = None

    def pieces(self, text: Column) -> Column:
        """What is counted of a text, as the JVM splits it; empty pieces don't count."""
        return self.terms(text)

    def split(self, docs: DataFrame, key: str) -> DataFrame:
        """``key, pieces``: a list for each text of the key."""
        texts = docs.select(key, F.coalesce("text", F.lit("")).alias("_x")).groupBy(key).agg(F.collect_list("_x").alias("_x"))
        return texts.select(key, F.transform("_x", self.pieces).alias("pieces"))

    def fit(self, docs: DataFrame, key: str = "comment_id") -> Tfidf:
        return self._fit(self.split(docs, key), docs)

    def sums(self, pieces: DataFrame) -> DataFrame:
        """``term, part, df, total`` of (pieces, part), in several rows each."""
        return pieces.select("pieces", "part").mapInArrow(_seen(self.units, self.grams), "term string, part long, df long, total long")

    def _fit(self, pieces: DataFrame, docs: DataFrame) -> Tfidf:
        seen = self.sums(pieces.withColumn("part", F.lit(0).cast("long"))).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where(F.col("df") >= self.min_df)
        kept = seen.orderBy(F.desc("total"), "term").limit(self.max_features)
        n = docs.agg(F.count("*").alias("_n"))
        self.vocabulary = kept.crossJoin(F.broadcast(n)).select("term", "df", "total", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
        return self

    def fit_folds(self, rows: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
        """The vocabularies of the rows outside each of the folds 0 to k - 1, each row a document, from one pass over the texts.

        Returns ``rows`` with ``at, tf``, numbers and counts of each text's terms, for their column ``text``, and the terms' idf, a column for each
        fold: not a number where the fold's vocabulary lacks the term.  There are at most ``k * max_features`` terms.
        """
        keep = tuple(c for c in rows.columns if c != "text")
        split = materialise(rows.select(*keep, F.array(self.pieces(F.coalesce("text", F.lit("")))).alias("pieces")), "pieces")
        own = {r.fold: r["count"] for r in split.where("fold is not null").groupBy("fold").count().collect()}  # k rows
        part = [F.coalesce(F.sum(F.when(F.col("part") == i, F.col(c))), F.lit(0)).alias(f"{c}{i}") for c in ("df", "total") for i in range(k)]
        seen = self.sums(split.where("fold is not null").withColumn("part", F.col("fold").cast("long"))).groupBy("term").agg(*part, F.sum("df").alias("df"), F.sum("total").alias("total"))
        seen = materialise(seen.where(F.col("df") >= self.min_df), "terms")
        idf = []
        for i in range(k):
            df, n = F.col("df") - F.col(f"df{i}"), sum(own.values()) - own.get(i, 0)
            kept = seen.where(df >= self.min_df).orderBy(F.desc(F.col("total") - F.col(f"total{i}")), "term").limit(self.max_features)
            idf.append(kept.select("term", F.lit(i).alias("part"), (F.log((1 + F.lit(n)) / (1 + df)) + 1).alias("idf")))
        found = reduce(DataFrame.unionByName, idf).groupBy("term").agg(*(F.max(F.when(F.col("part") == i, F.col("idf"))).alias(f"idf{i}") for i in range(k))).toArrow().sort_by("term")
        context = rows.sparkSession.sparkContext
        schema = StructType([*(f for f in split.schema if f.name in keep), *(StructField(c, ArrayType(IntegerType())) for c in ("at", "tf"))])
        bags = materialise(split.mapInArrow(_numbered(self.units, self.grams, context.broadcast(found.select(["term"])), keep), schema), "bags")
        for done in (split, seen):
            delete_shared(rows.sparkSession, done.shared_path)
        return bags, np.column_stack([found.column(f"idf{i}").to_numpy().astype(float) for i in range(k)])

    def transform(self, docs: DataFrame, key: str = "comment_id") -> DataFrame:
        return self._weights(self.split(docs, key), key)

    def fit_transform(self, docs: DataFrame, key: str = "comment_id") -> DataFrame:
        """``fit`` and ``transform`` of the same texts, which are split once and stored."""
        pieces = materialise(self.split(docs, key), "pieces")
        self._fit(pieces, docs.select(key))
        return self._weights(pieces, key)

    def _weights(self, pieces: DataFrame, key: str) -> DataFrame:
        if self.vocabulary is None:
            raise ValueError("fit comes first")
        known = pieces.sparkSession.sparkContext.broadcast(self.vocabulary.select("term", "idf").toArrow())
        schema = StructType([pieces.schema[key], StructField("term", StringType()), StructField("weight", DoubleType())])
        return pieces.select(key, "pieces").mapInArrow(_weighted(self.units, self.grams, known, key), schema)


class _Words(Tfidf):
    units = staticmethod(word_units)

    def pieces(self, text: Column) -> Column:
        return T.tokenize(text, self.pair)


class _Grams(Tfidf):
    grams = staticmethod(word_grams)

    def pieces(self, text: Column) -> Column:
        return F.split(T.squeeze(F.lower(text)), " ")


def tfidf_word(pair: LanguagePair = KAZAKH_RUSSIAN, max_features: int = WORD_FEATURES) -> Tfidf:
    out = _Words(lambda t: word_terms(t, pair), max_features)
    out.pair = pair
    return out


def tfidf_char(pair: LanguagePair = KAZAKH_RUSSIAN, max_features: int = CHAR_FEATURES) -> Tfidf:
    return _Grams(char_terms, max_features)


def unit(vector: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-9)))


def mean_vectors(tokens: DataFrame, vectors: DataFrame, dim: int, key: str = "comment_id") -> DataFrame:
    """``key, vector``: the unit mean of the word vectors (word, vector) of each text's words (key, word); zeros without any.

    Sums are taken by dimension in one aggregation, so no text's vectors are gathered.
    """
    joined = tokens.join(vectors, "word", "left")
    sums = joined.groupBy(key).agg(*(F.avg(F.col("vector")[i].cast("double")).alias(f"d{i}") for i in range(dim)))
    return sums.select(key, unit(F.array(*(F.coalesce(f"d{i}", F.lit(0.0)) for i in range(dim)))).alias("vector"))


def masked_mean(states: Column, mask: Column, dim: int) -> Column:
    """Unit mean of the vectors of ``states`` (an array of arrays) where ``mask`` is 1."""
    kept = F.filter(F.zip_with(states, mask, lambda s, m: F.struct(s.alias("s"), m.alias("m"))), lambda x: x.m == 1)
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(kept, zero, lambda acc, x: F.zip_with(acc, x.s, lambda p, q: p + q.cast("double")))
    return unit(F.transform(total, lambda x: x / F.greatest(F.size(kept).cast("double"), F.lit(1e-9))))


def skipgram(docs: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN, dim: int = 100, window: int = 5, min_count: int = 2, epochs: int = 10, seed: int = 2026) -> DataFrame:
    """``word, vector`` trained on unlabelled texts by skip-gram, with vectors for character strings too.

    Words and their strings of three to five characters are trained as one vocabulary, a word's
    sentence holding its strings beside it, so unseen words have a vector through their strings.
    This stands in for subword skip-gram, which Spark lacks; its vectors are not equal to that model's.
    """
    from pyspark.ml.feature import Word2Vec

    sentences = docs.select(T.tokenize(F.coalesce("text", F.lit("")), pair).alias("w")).where(F.size("w") > 0)
    enriched = sentences.select(F.flatten(F.transform("w", lambda w: F.concat(F.array(w), F.transform(char_terms(w), lambda g: F.concat(F.lit("#"), g))))).alias("w"))
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, inputCol="w", outputCol="v").fit(enriched)
    return model.getVectors().select("word", F.expr("vector").alias("vector"))


def cached_vectors(docs: DataFrame, folder: str, **options) -> DataFrame:
    """``skipgram`` vectors from ``folder``, trained and written there if it holds none."""
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        skipgram(docs, **options).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def encoder_vectors(embeddings: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key, vector``: precomputed vectors of a frozen encoder, scaled to unit length."""
    return embeddings.select(key, unit(F.col(column)).alias("vector"))


#: Representations by name.  ``corpus_level`` ones are fitted once, on unlabelled text; the others on each fold's training rows.
REPRESENTATIONS: dict[str, dict] = {
    "tfidf_word": {"make": tfidf_word, "corpus_level": False},
    "tfidf_char": {"make": tfidf_char, "corpus_level": False},
    "fasttext": {"make": skipgram, "corpus_level": True},
    "xlmr": {"make": encoder_vectors, "corpus_level": True},
}
