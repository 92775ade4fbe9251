"""A corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  All but
the last return the columns of ``documents``; other columns of ``docs``, whatever their names, are dropped.  Null texts
count as empty, rows without doc_id stay in every filter, and an empty ``docs`` gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe import BytePairCodec, encode_and_decode
from corpusloom.llm.decontaminate import without_contaminated
from corpusloom.llm.ngram_join import keep_one_of_each_class
from corpusloom.llm.pii import redact
from corpusloom.llm.shared import shared_path
from corpusloom.llm.toxicity import without_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Toxicity is a fitted model, and byte-pair merges have no SQL form.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold.

    Null and empty texts score the base rate and stay; rows that share a doc_id go if one of them scores the threshold or more.
    Without labels of both classes nothing can be learnt, and without toxic ones nothing goes.
    """
    return without_toxic(docs, _table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near duplicates.

    Texts without words are alone in their class and stay; rows that share a doc_id are one document and stay or go together.
    """
    return keep_one_of_each_class(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; with an empty benchmark, all of them.  Rows that share a doc_id go if one of them holds one."""
    return without_contaminated(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with spans of personal data replaced by their kinds; null texts stay null, repeated rows repeated."""
    return redact(docs).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, text_sha256``: each document's ids, and the hash of the bytes that they decode to; one row for each row of ``docs``."""
    import public_tokenizers

    codec = BytePairCodec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    found = encode_and_decode(docs, codec)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
