"""Session settings the plans rely on, and shared-storage helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: What the plans expect of a session. Joins carry no broadcast hints: Spark broadcasts a
#: side only when its size is known to be under ``autoBroadcastJoinThreshold`` (checked
#: again at run time by AQE) and otherwise uses a sort-merge join, whose hot partitions
#: the two skew settings split.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Lets the text readers decode Korean Windows files (see sources.readers.charset).
    "spark.sql.legacy.javaCharsets": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SESSION_CONF` to a running session and return it."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_path(spark: SparkSession) -> str | None:
    """A new path under the cluster's ``spark.checkpoint.dir``, if the session names one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return f"{folder.rstrip('/')}/tallywright/{uuid.uuid4().hex}" if folder else None


def write_through(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` to ``folder``, or the cluster's shared checkpoint folder, and read it back.

    Cuts lineage at a point several results start from, so that they do not repeat the
    scan behind it, and so that a lost executor costs a re-read instead of a re-run. Spark
    also knows the size of a stored table, and sends it to the other side of a join where it
    is small. Where the session names no folder the plan is returned as it is, which is
    slower but gives the same rows.
    """
    spark = df.sparkSession
    path = f"{folder}/{uuid.uuid4().hex}" if folder else shared_path(spark)
    if path is None:
        return df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of stored tables, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def together(*tasks: Callable[[], DataFrame]) -> list[DataFrame]:
    """Results of independent tasks, whose jobs run side by side on the cluster."""
    with ThreadPoolExecutor(max_workers=len(tasks)) as pool:
        # Each thread takes the job group, pool and tags of its caller.
        inherit = inheritable_thread_target(SparkSession.active())
        futures = [pool.submit(inherit(task)) for task in tasks]
        return [future.result() for future in futures]
