"""Frozen cross-validation folds and a held-out test split, balanced by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import SEED, shuffled


def make_folds(rows: DataFrame, k: int = 5, test_share: float = 0.15, seed: int = SEED, key: str = "comment_id", cell: str = "stratum") -> DataFrame:
    """``rows`` with ``split`` (test or train) and ``fold`` (0 to k - 1; null for test).

    Each cell gives its share of test rows, rounded half to even, and deals the rest in turn
    from a start that differs by cell.
    """
    by = Window.partitionBy(cell).orderBy(shuffled(key, seed), key)
    n_test = F.bround(F.count("*").over(Window.partitionBy(cell)) * F.lit(test_share)).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}#"), F.col(cell)).cast("binary")), 1, 8), 16, 10).cast("long") % k
    numbered = rows.withColumns({"_k": F.row_number().over(by).cast("long"), "_t": n_test, "_o": offset})
    test = F.col("_k") <= F.col("_t")
    fold = F.when(~test, (F.col("_k") - F.col("_t") - 1 + F.col("_o")) % k)
    return numbered.withColumns({"split": F.when(test, "test").otherwise("train"), "fold": fold}).drop("_k", "_t", "_o")


def nested(folds: DataFrame, k: int, seed: int = SEED, test_share: float = 0.15, key: str = "comment_id") -> DataFrame:
    """One row ``seed, k, test_share, n_labeled, folds, test``: the frozen form, for tables of labels."""
    return folds.agg(
        F.lit(seed).alias("seed"),
        F.lit(k).alias("k"),
        F.lit(test_share).alias("test_share"),
        F.count("*").alias("n_labeled"),
        F.array(*(F.sort_array(F.collect_list(F.when(F.col("fold") == i, F.col(key)))) for i in range(k))).alias("folds"),
        F.sort_array(F.collect_list(F.when(F.col("split") == "test", F.col(key)))).alias("test"),
    )


def flat(frozen: DataFrame, key: str = "comment_id") -> DataFrame:
    """``key, split, fold`` from the frozen form."""
    train = frozen.select(F.posexplode("folds").alias("fold", "ids")).select(F.explode("ids").alias(key), F.lit("train").alias("split"), F.col("fold").cast("long"))
    return train.unionByName(frozen.select(F.explode("test").alias(key), F.lit("test").alias("split"), F.lit(None).cast("long").alias("fold")))


def fold_counts(folds: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows of each value in each fold and in the test split."""
    name = F.when(F.col("split") == "test", "test").otherwise(F.concat(F.lit("fold "), (F.col("fold") + 1).cast("string")))
    return folds.groupBy(name.alias("part")).agg(F.count("*").alias("n"), *(F.count_if(F.col(column) == v).alias(v) for v in values))


def thin(folds: DataFrame, column: str, values: tuple[str, ...], k: int, least: int = 20) -> DataFrame:
    """``value, least, thin``: each value's smallest fold, and whether it is under ``least``."""
    spark = folds.sparkSession
    grid = spark.createDataFrame([(v, i) for v in values for i in range(k)], "value string, fold long")  # values times folds
    counts = folds.where("fold is not null").groupBy(F.col(column).alias("value"), "fold").agg(F.count("*").alias("n"))
    return grid.join(counts, ["value", "fold"], "left").groupBy("value").agg(F.min(F.coalesce("n", F.lit(0))).alias("least")).withColumn("thin", F.col("least") < least)
