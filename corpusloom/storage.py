"""Intermediate tables in the folder that a cluster shares, ``spark.checkpoint.dir``.

Lineage is cut by writing Parquet there; a lost executor then costs the tasks it ran and never a finished stage.
Nothing is kept only on one machine.  A result still reads such tables after the call that made them, so they stay until ``clear``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}
#: What this process has written, by application.
_written: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  A local session without one gets a temporary folder, deleted at exit; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[context.applicationId] = "file://" + folder
    return _own[context.applicationId]


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, with its lineage cut."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def delete_shared(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete all that operators have written for this application; results not yet written elsewhere are lost."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        delete_shared(spark, path)
