"""Readers: explicit schemas, columns pruned at the scan, files chosen before they are opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.evaluation import last_rows

from . import schemas

#: Sources that a corpus leaves out unless asked for.
REJECTED_FILES = ("kids_gaming.jsonl",)


def _excluded(df: DataFrame, names: tuple[str, ...] = (), parts: tuple[str, ...] = ()) -> DataFrame:
    """Without files of these names, or whose names hold these parts; Spark prunes the files by this."""
    name = F.col("_metadata.file_name")
    if names:
        df = df.where(~name.isin(*names))
    for p in parts:
        df = df.where(~name.contains(p))
    return df


def read_raw(spark: SparkSession, path: str, exclude: tuple[str, ...] = (), include_rejected: bool = False) -> DataFrame:
    """Raw comments as JSON lines, with ``source_file`` and ``seq``; author, channel and time of pull are never read.

    ``seq`` orders rows by file name, then by place in the file: a file's rows are numbered by their block's start and their
    place in it.  Blank lines are no rows.
    """
    schema = ", ".join(c for c in schemas.RAW_COMMENTS.split(", ") if c.split()[0] not in ("channel_id", "author", "pulled_at"))
    rows = _excluded(spark.read.schema(schema).json(path), exclude + (() if include_rejected else REJECTED_FILES))
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", F.col("_metadata.file_name").alias("source_file"), at.alias("seq"))


def read_clean(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> DataFrame:
    rows = spark.read.schema(schemas.CLEAN_CORPUS).json(path)
    return rows.select(*columns) if columns else rows


def read_csv(spark: SparkSession, path: str, schema: str, exclude: tuple[str, ...] = (), parts: tuple[str, ...] = (), check: tuple[str, ...] = ()) -> DataFrame:
    """A CSV table by header names, BOM or not, quotes doubled, line feeds in cells; empty cells as "".

    ``file`` (the name without its ending) and ``line`` are added.  Columns that the file lacks are "", unless ``check`` asks for them.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in check if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} is missing columns: {', '.join(missing)}")
    raw = _excluded(raw, exclude, parts)
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in names]
    at = F.monotonically_increasing_id() % (1 << 33) + 2
    typed = {c.split()[0]: c.split()[1] for c in schema.split(", ")}
    out = raw.select(*cells, F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("file"), at.alias("line"))
    return out.withColumns({c: F.col(c).try_cast(t) for c, t in typed.items() if t != "string"}) if any(t != "string" for t in typed.values()) else out


def read_sheets(spark: SparkSession, path: str, check: bool = False, skip_retests: bool = False) -> DataFrame:
    """Annotation sheets, manifests left out."""
    parts = ("manifest", "retest") if skip_retests else ("manifest",)
    return read_csv(spark, path, schemas.SHEET, parts=parts, check=("comment_id", "text", "sentiment", "density", "base_lang") if check else ())


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    return read_sheets(spark, path).where(F.trim("comment_id") != "")


def read_sheet_last(spark: SparkSession, path: str) -> DataFrame:
    """A sheet with one row for each id, the last."""
    return last_rows(read_sheets(spark, path))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """The labelled corpus; ``density_eligible`` as a boolean, ``n_tokens`` as a number."""
    rows = read_csv(spark, path, schemas.LABELLED)
    return rows.withColumns({"density_eligible": F.lower("density_eligible") == "true", "n_tokens": F.col("n_tokens").try_cast("int")})


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, schemas.PREDICTIONS)
    return rows.withColumns({"n_tokens": F.col("n_tokens").try_cast("int"), "fold": F.col("fold").try_cast("int")})


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FOLDS).option("multiLine", True).json(path)


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """``reply, raw``: whole reply files, named without their ending."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("reply"), F.col("value").alias("raw"))


def read_prompt_index(spark: SparkSession, path: str) -> DataFrame:
    """``prompt, n, ids`` of every entry: one a line, as ``write_prompts`` leaves them, or all in one array, over any lines."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.left(F.trim("value"), F.lit(1)).alias("c")).head()
    # By whole files, Spark reads one value a file and no more; by lines, only arrays that stand on one.
    return spark.read.schema(schemas.PROMPT_INDEX).option("multiLine", first is not None and first.c == "[").json(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """``prompt, body``: the prompt texts of ``write_prompts``."""
    return spark.read.schema("body string, prompt string").text(path, wholetext=True).select("prompt", "body")


def channel_sources(spark: SparkSession, path: str) -> DataFrame:
    """Sources with a channel."""
    return read_csv(spark, path, schemas.SOURCES).where(F.trim("channel_id") != "")


def searchable_sources(spark: SparkSession, path: str, max_priority: int = 2) -> DataFrame:
    """Sources that aren't rejected, by priority; a blank or odd priority counts as 9."""
    rows = read_csv(spark, path, schemas.SOURCES)
    return rows.where(~F.col("note").contains("REJECTED")).where(F.coalesce(F.trim("priority").try_cast("int"), F.lit(9)) <= max_priority)


def unverified_sources(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.SOURCES).where(F.lower(F.trim("verified")) != "yes")


def videos_to_pull(spark: SparkSession, path: str) -> DataFrame:
    """Videos with an id that aren't marked as pulled."""
    rows = read_csv(spark, path, schemas.VIDEOS).where(F.trim("video_id") != "")
    return rows.where(F.lower(F.trim("pulled")) != "yes").withColumn("video_id", F.trim("video_id"))
