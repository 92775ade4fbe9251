"""Sinks: Spark's committers write; nothing overwrites the path that it reads."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.storage import delete_shared, materialise

CLEAN_COLUMNS = ("comment_id", "video_id", "source_file", "text", "n_tokens", "screen_kk", "screen_ru", "screen_bucket", "density_eligible", "like_count", "published_at")


def write_corpus(done: DataFrame, folder: str) -> None:
    """The clean, romanized and other-language pools, from one pass: partitions ``pool=...`` of JSON lines."""
    renamed = done.withColumnsRenamed({"screen_a": "screen_kk", "screen_b": "screen_ru"})
    present = [c for c in (*CLEAN_COLUMNS, "language") if c in renamed.columns]
    renamed.where("pool is not null").select("pool", *present).write.partitionBy("pool").json(folder)


def append_new(spark: SparkSession, new: DataFrame, path: str, key: str = "comment_id") -> None:
    """Append rows whose key the target lacks, the first of each key: resuming a pull writes nothing twice.

    First is the least ``seq``, which is not written; without that column, the least row by value.
    """
    columns = [c for c in new.columns if c not in (key, "seq")]
    least = F.min(F.struct(*(c for c in ("seq",) if c in new.columns), *columns)).alias("_first")
    rows = new.groupBy(key).agg(least).select(*(F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in new.columns if c != "seq"))
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        rows = rows.join(spark.read.schema(f"{key} string").json(path).distinct(), key, "left_anti")
    rows.write.mode("append").json(path)


def write_sheets(batched: DataFrame, folder: str) -> None:
    """Sheets to fill in, a folder ``batch=...`` for each, with blank label columns; a batch beyond one partition's advisory size becomes several files."""
    blank = {c: F.lit("") for c in ("sentiment", "density", "base_lang", "notes")}
    batched.withColumns(blank).select("batch", "comment_id", "text", *blank).hint("rebalance", "batch").write.partitionBy("batch").option("header", True).option("escape", '"').csv(folder)


def write_csv(df: DataFrame, folder: str, order: tuple[Column | str, ...] = ()) -> None:
    """A CSV table, sorted if an order is given; once written it stays (``errorifexists``)."""
    (df.orderBy(*order) if order else df).write.option("header", True).option("escape", '"').csv(folder)


def write_once(df: DataFrame, folder: str, force: bool = False) -> None:
    """Frozen results: refused if they are there, unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").json(folder)


def write_prompts(prompted: DataFrame, folder: str) -> None:
    """Prompt texts in ``prompt=...`` folders, replacing all old ones, and their index, an entry a line; both of the same prompts, computed once."""
    prompted = materialise(prompted, "prompts")
    prompted.select("prompt", F.col("body").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("prompt").text(f"{folder}/prompts")
    prompted.select("prompt", "n", "ids").write.mode("overwrite").json(f"{folder}/index")
    delete_shared(prompted.sparkSession, prompted.shared_path)


def write_videos(videos: DataFrame, folder: str) -> None:
    write_csv(videos, folder, (F.desc("comment_count"), "video_id"))


def replace(df: DataFrame, folder: str, format: str = "parquet", **options) -> None:
    """Put ``df`` in the place of ``folder``, which it may have been read from: written beside it, then renamed.

    Where the second rename fails, the old folder is put back.
    """
    spark = df.sparkSession
    fresh, old = f"{folder}.new-{uuid.uuid4().hex}", f"{folder}.old-{uuid.uuid4().hex}"
    df.write.format(format).options(**options).save(fresh)
    jvm = spark.sparkContext._jvm
    paths = {name: jvm.org.apache.hadoop.fs.Path(name) for name in (folder, fresh, old)}
    system = paths[folder].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(paths[folder]) and not system.rename(paths[folder], paths[old]):
        raise OSError(f"{folder} can't be moved aside")
    if not system.rename(paths[fresh], paths[folder]):
        if system.exists(paths[old]):
            system.rename(paths[old], paths[folder])
        raise OSError(f"{fresh} can't be renamed")
    system.delete(paths[old], True)
