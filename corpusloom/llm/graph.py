"""Connected components by alternating large and small stars, as DataFrame joins.

No vertex's neighbours are ever gathered: each half-step takes the least neighbour of
every vertex by a partially aggregated minimum and joins it back, with the centres of large stars
split off (``join_unique``).  Every half-step is written to the shared folder, so one is the most that a lost executor costs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import delete_shared, join_unique, shared_path

_EDGES = "u long, v long"


def _with_least(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v) with m, the least of u and of all v that stand beside u; ``total`` bounds the number of pairs."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n_rows"))
    return join_unique(pairs, least, ["u"], total).select("u", "v", F.least("u", "least").alias("m"))


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame, n: int) -> DataFrame:
    small = _with_least(edges, n)
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of ``edges``; root is the least node of its component.

    Null ends and loops are ignored; a graph without edges gives no rows.  Rounds end when one changes nothing, after
    a number of them that grows with the logarithm of the number of nodes.
    """
    spark = edges.sparkSession

    def written(table: DataFrame, old: str | None) -> tuple[str, DataFrame]:
        path = shared_path(spark, "components")
        table.write.parquet(path)
        if old:
            delete_shared(spark, old)
        return path, spark.read.schema(_EDGES).parquet(path)

    path, now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct(), None)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        path, now = written(_large(now, mark[0]), path)
        path, now = written(_small(now, mark[0]), path)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
