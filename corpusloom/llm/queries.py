"""Registered queries of this subpackage: opN_<name> for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.roles import table as _table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import BytePairCodec, encode_and_decode

    codec = BytePairCodec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    found = encode_and_decode(_table(spark, sf_dir, "documents"), codec)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import read_tokens, write_tokens

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    found = read_tokens(spark, write_tokens(_table(spark, sf_dir, "documents"), definition))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds sound, so the UTF-8 bytes of each text stand in for a recording's 8-bit PCM samples."""
    from .audio import align

    docs = _table(spark, sf_dir, "documents")
    recordings = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("pcm"))
    found = align(recordings, F.col("doc_id") % 100 == 0)
    return found.select("doc_id", "class_id", "n_codes", F.crc32("codes").alias("codes_crc32"), "matches")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, KINDS, find_spans, listed

    found = find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.base)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    found = suffix_dedup(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contained_items

    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_packages, write_packages

    found = read_packages(write_packages(_table(spark, sf_dir, "pages")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import extract

    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, fit, held_out, score

    docs = _table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """DuckDB forms, where SQL can express an operator on whole tables."""
    from . import oracle

    return {
        "op4_ngram_jaccard_join": oracle.NGRAM_JOIN,
        "op6_suffix_dedup": oracle.SUFFIX_DEDUP,
        "op7_benchmark_decontamination": oracle.DECONTAMINATION,
        "op8_warc": oracle.WARC,
    }
