"""What the operators share: intermediate tables of the shared folder, bounded Arrow batches, and joins with hot keys.

Tables that later ones have replaced are deleted by ``discard``; those that a result still
reads stay until ``clear`` is called.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.storage import clear, delete_shared, materialise, shared_path

#: Rows and bytes of an Arrow batch: whole texts travel in them, and Spark's own defaults, 10,000 rows or 64 MB, stand several times over in the JVM
#: and in Python.  A row of more bytes is a batch of its own.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by ``BATCH_ROWS`` and ``BATCH_BYTES``, unless the session asks for fewer; takes effect for plans run from now on."""
    rows, size = (f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes"))
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    at_most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size, "64m"))
    if not 0 < at_most <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing still to be computed reads, and let Spark's cleaner find the shuffle files of their stages.

    It drops those when the driver's JVM collects their handles, which it otherwise may not do for half an hour.
    """
    for table in tables:
        delete_shared(table.sparkSession, table.shared_path)
    spark = tables[0].sparkSession
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with marks behind it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose key is not in the one column of ``ids``, with all their columns; null keys stay."""
    name = fresh(df, "gone")
    gone = ids.toDF(name)
    return df.join(gone, df[key] == gone[name], "left_anti")


#: A key is hot if it has more than one in so many of the rows; no more keys than this can be.
HOT_SHARE = 512


def join_unique(many: DataFrame, one: DataFrame, keys: list[str], total: int, n: str = "n_rows") -> DataFrame:
    """Inner join of ``many`` with ``one``, a table of unique keys whose column ``n`` counts the rows of ``many`` with each.

    ``total`` is at least the number of rows of ``many``.  Hot keys, at most ``HOT_SHARE`` rows of ``one``, are
    broadcast, so their rows stay where they are; all others are shuffled, in groups of at most total / HOT_SHARE rows.
    Without a hot key the plan is a plain join.
    """
    hot = F.col(n) > total // HOT_SHARE
    if one.where(hot).isEmpty():
        return many.join(one.drop(n), keys)
    mark = fresh(many.join(one, keys), "is_hot")
    marked = many.join(F.broadcast(one.where(hot).drop(n).withColumn(mark, F.lit(True))), keys, "left")  # one broadcast for both branches
    cold = marked.where(F.col(mark).isNull()).select(*many.columns).join(one.where(~hot).drop(n), keys)
    return marked.where(mark).drop(mark).unionByName(cold)


__all__ = ["clear", "delete_shared", "discard", "fresh", "join_unique", "materialise", "shared_path", "small_batches", "without_ids"]
