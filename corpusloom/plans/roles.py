"""The driver's tables in the roles of a comment corpus.

A document is a comment, its source the video and its language the source file; labels are two
annotators' sheets.  Every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.profiles import FRENCH_ENGLISH as PAIR
from corpusloom.operators import corpus as C
from corpusloom.operators import sampling as S
from corpusloom.storage import materialise

#: Longer than any document, where length is not what a query is about.
NO_LIMIT = 1_000_000_000
REPRESENTATIONS = ("rep_a", "rep_b", "rep_c")


#: Tables of whole texts.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; one of texts that a scan would read in fewer tasks than there are cores, as one row group is one task, is dealt out to all."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if name in TEXTS and rows.rdd.getNumPartitions() < cores else rows


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("comment_id"), F.col("source").alias("video_id"), F.col("lang").alias("source_file"), "text", F.col("doc_id").alias("seq"))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_text(raw(spark, sf_dir))


def outcomes(spark: SparkSession, sf_dir: str, max_chars: int = T.MAX_CHARS) -> DataFrame:
    """Every document's outcome of routing and deduplication, without its text."""
    return C.outcomes(materialise(C.keyed(C.route(cleaned(spark, sf_dir), PAIR, max_chars), PAIR), "keys"))


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.screen(cleaned(spark, sf_dir), PAIR)


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling pool: every document, with its screen bucket as stratum."""
    n = T.n_tokens(F.col("text"), PAIR)
    rows = screened(spark, sf_dir).select("comment_id", "video_id", "screen_bucket", n.alias("n_tokens"), (n >= T.MIN_DENSITY_TOKENS).alias("density_eligible"))
    return materialise(rows, "pool")  # read by each step of a draw


def sheets(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Labelled documents as sheets: quality is the sentiment, toxicity the base language, length the density; ``more`` columns of a document follow."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.select(
        F.col("source").alias("file"),
        F.col("doc_id").alias("line"),
        F.col("doc_id").cast("string").alias("comment_id"),
        F.when(F.col("n_chars") % 7 == 0, "skip").when(F.col("n_chars") % 11 == 0, "").when(F.col("quality") == 1, " Pos").otherwise("neg").alias("sentiment"),
        F.when(F.col("n_chars") % 13 == 0, "hi").when(F.col("n_chars") < 900, "mono").when(F.col("n_chars") < 1800, "low").otherwise("high").alias("density"),
        F.when(F.col("n_chars") % 17 == 0, "").when(F.col("toxic") == 1, "KK").otherwise("ru").alias("base_lang"),
        F.lit("").alias("notes"),
        *more,
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as predictions of three representations that err by the hash of name and id."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    gold = F.when(F.col("toxic") == 1, "neg").when(F.col("quality") == 1, "pos").otherwise("neu")
    density = F.when(F.col("n_chars") < 900, "mono").when(F.col("n_chars") < 1500, "low").when(F.col("n_chars") < 2500, "med").otherwise("high")
    j = j.select(F.col("doc_id").alias("comment_id"), gold.alias("gold"), density.alias("density"), T.n_tokens(F.col("text"), PAIR).alias("n_tokens"), F.explode(F.array(*map(F.lit, REPRESENTATIONS))).alias("representation"))
    die = F.substring(F.md5(F.concat("representation", F.lit("|"), F.col("comment_id").cast("string")).cast("binary")), 1, 1)
    other = F.when(F.col("gold") == "neg", "neu").when(F.col("gold") == "neu", "pos").otherwise("neg")
    limit = F.when(F.col("representation") == "rep_a", "d").when(F.col("representation") == "rep_b", "b").otherwise("9")
    return j.withColumn("pred", F.when(die < limit, F.col("gold")).otherwise(other)).withColumns({"classifier": F.lit("logreg"), "fold": F.lit(1)})


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with text, gold label, cell and key, for folds and features."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    gold = F.when(F.col("quality") == 1, "pos").otherwise("neg")
    density = F.when(F.col("n_chars") < 1500, "low").otherwise("high")
    return j.select(F.col("doc_id").alias("comment_id"), "text", gold.alias("gold"), density.alias("density"), T.n_tokens(F.col("text"), PAIR).alias("n_tokens")).withColumn("stratum", T.stratum(F.col("gold"), F.col("density")))


__all__ = ["PAIR", "S", "T", "C", "cleaned", "labelled", "outcomes", "pool", "predictions", "raw", "screened", "sheets", "table"]
