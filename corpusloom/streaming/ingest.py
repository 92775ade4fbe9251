"""Incremental ingest: new raw files become cleaned, routed rows as they arrive.

A comment that was pulled again within the watermark is dropped by the stream's state, which the watermark
bounds; older repeats fall to the batch build's rule that the first row of an id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.profiles import KAZAKH_RUSSIAN, LanguagePair
from corpusloom.functions.text import MAX_CHARS
from corpusloom.operators.corpus import clean_text, route, screen
from corpusloom.sources.schemas import RAW_COMMENTS


def raw_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(RAW_COMMENTS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def routed_stream(raw: DataFrame, pair: LanguagePair = KAZAKH_RUSSIAN, max_chars: int = MAX_CHARS, late: str = "7 days") -> DataFrame:
    """Row rules and the screen on a stream, each comment id once within ``late``; a row without time of pull is taken as new."""
    timed = raw.withColumn("pulled", F.coalesce(F.try_to_timestamp("pulled_at"), F.current_timestamp())).withWatermark("pulled", late)
    return screen(route(clean_text(timed.dropDuplicatesWithinWatermark(["comment_id"]).drop("author", "channel_id")), pair, max_chars), pair)


def bucket_stream(routed: DataFrame, window: str = "1 hour") -> DataFrame:
    """Rows of each screen bucket in each window of the time of pull."""
    return routed.groupBy(F.window("pulled", window), "screen_bucket").agg(F.count("*").alias("n"))


def run_stream(routed: DataFrame, out: str, checkpoint: str):
    """Append routed rows as Parquet; what has arrived is taken and the stream stops."""
    return routed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
