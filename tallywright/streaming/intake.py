"""Chunked intake: a folder of extracts, appended to Parquet a few files at a time.

Each run takes the files that arrived since the last one and stops. Progress is kept in
``progress_path``, so a run that is cut off goes on where it was without doubling rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallywright.sources.readers import (
    BAD_LINE,
    TextOptions,
    fitting_lines,
    reader_options,
    with_bad_line,
)


def append_new_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    target: str,
    progress_path: str,
    options: TextOptions = TextOptions(),
    files_per_chunk: int = 100,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> StreamingQuery:
    """Start one run; ``awaitTermination()`` on the result waits for its end.

    Lines that do not fit the schema stop the run, or are left to
    :func:`append_rejected_lines` if the options set them aside.
    """
    rows = fitting_lines(_lines(spark, folder, schema, options, files_per_chunk), options)
    return _append(prepare(rows), target, progress_path)


def append_rejected_lines(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    target: str,
    progress_path: str,
    options: TextOptions = TextOptions(),
    files_per_chunk: int = 100,
) -> StreamingQuery:
    """The same for the lines that do not fit, as ``file, line``, with progress of its own."""
    lines = _lines(spark, folder, schema, options, files_per_chunk)
    read = F.length(F.coalesce(lines.columns[0], F.lit(""))) >= 0
    bad = lines.filter(F.col(BAD_LINE).isNotNull() & read).select(
        F.input_file_name().alias("file"), F.col(BAD_LINE).alias("line")
    )
    return _append(bad, target, progress_path)


def _lines(
    spark: SparkSession, folder: str, schema: T.StructType, options: TextOptions, files_per_chunk: int
) -> DataFrame:
    return (
        spark.readStream.schema(with_bad_line(schema))
        .options(**reader_options(options))
        .option("maxFilesPerTrigger", files_per_chunk)
        .csv(folder)
    )


def _append(rows: DataFrame, target: str, progress_path: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", progress_path)
        .option("path", target)
        .trigger(availableNow=True)
        .start()
    )


#: Folders of one batch under the root of :func:`intake_checked`.
ACCEPTED, REJECTED, STAGING = "accepted", "rejected", "_staging"


def intake_checked(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    root: str,
    progress_path: str,
    options: TextOptions = TextOptions(),
    files_per_chunk: int = 100,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    between: Callable[[int], None] = lambda batch_id: None,
) -> StreamingQuery:
    """One run that reads each new file once and writes both the lines that fit and the others.

    Each micro-batch is kept for its two writes, which go to ``root/_staging/batch=N``; one
    rename then publishes the batch as ``root/batch=N`` with ``accepted`` and ``rejected`` in it.
    A run cut off at any point is started again with the same ``progress_path``: the batch is
    written anew over what was left, so readers (:func:`checked_lines`) see both parts of a batch
    or neither, and no line twice. ``between`` is called between the two writes (for tests).
    """
    lines = _lines(spark, folder, schema, options, files_per_chunk).withColumn("_file", F.input_file_name())
    read = F.length(F.coalesce(lines.columns[0], F.lit(""))) >= 0

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            staging = f"{root.rstrip('/')}/{STAGING}/batch={batch_id}"
            kept = batch.filter(F.col(BAD_LINE).isNull() & read).drop(BAD_LINE, "_file")
            prepare(kept).write.mode("overwrite").parquet(f"{staging}/{ACCEPTED}")
            between(batch_id)
            bad = batch.filter(F.col(BAD_LINE).isNotNull() & read).select(
                F.col("_file").alias("file"), F.col(BAD_LINE).alias("line")
            )
            bad.write.mode("overwrite").parquet(f"{staging}/{REJECTED}")
            _publish(spark, staging, f"{root.rstrip('/')}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", progress_path)
        .trigger(availableNow=True)
        .start()
    )


def _publish(spark: SparkSession, staging: str, final: str) -> None:
    """Move a written batch into place, over any copy an earlier, cut-off run left there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    source, target = hadoop(staging), hadoop(final)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"could not publish {staging} as {final}")


def checked_lines(spark: SparkSession, root: str, part: str = ACCEPTED) -> DataFrame:
    """Lines of all published batches of :func:`intake_checked`: ``accepted`` or ``rejected``."""
    return spark.read.option("basePath", root).parquet(f"{root.rstrip('/')}/batch=*/{part}").drop("batch")
