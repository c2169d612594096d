"""Writing prepared ledgers, trial balances and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallywright.operators.mapping import column
from tallywright.sources.readers import TextOptions, charset, read_parquet, read_text_files

_TYPED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def stringify(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast columns to text: those named, or all that are not numbers, dates or flags.

    Null stays null.
    """
    chosen = (
        set(columns)
        if columns is not None
        else {f.name for f in df.schema.fields if not isinstance(f.dataType, _TYPED)}
    )
    return df.select(
        *(
            column(name).cast("string").alias(name) if name in chosen else column(name)
            for name in df.columns
        )
    )


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    files: int | None = None,
    mode: str = "errorifexists",
) -> None:
    """Parquet, optionally laid out by columns such as year and month.

    Rows of one partition value are brought together by a rebalance, which Spark splits
    again where one value is large (a closing month, say), so no task writes all of it.
    ``files`` asks for a fixed number of files instead; 1 puts everything in one task and
    is for small results only.
    """
    if files is not None:
        df = df.repartition(files)
    elif partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_ledger(gl: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Standard ledger laid out by year and month, which reviews prune by."""
    write_parquet(gl, path, ("year_label", "fiscal_month"), mode=mode)


def compact(
    spark: SparkSession, source: str, target: str, files: int | None = None, merge: bool = False
) -> None:
    """Rewrite many small Parquet files as few; without ``files`` Spark picks their size."""
    df = read_parquet(spark, source, merge_schema=merge)
    df = df.repartition(files) if files is not None else df.hint("rebalance")
    df.write.parquet(target)


def write_text(
    df: DataFrame,
    path: str,
    sep: str = "\t",
    encoding: str = "utf-8",
    mode: str = "errorifexists",
    quoting: bool = True,
) -> None:
    """Delimited text with a heading in each part file; blanks around values are kept.

    ``quoting=False`` writes quotes as plain characters, as the reader with that option reads them.
    """
    (
        df.write.mode(mode)
        .option("sep", sep)
        .option("header", True)
        .option("encoding", charset(encoding))
        .option("quote", '"' if quoting else "")
        .option("escape", '"' if quoting else "\\")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def recode_text(
    spark: SparkSession,
    source: str,
    target: str,
    options: TextOptions,
    encoding: str = "utf-8",
    keep_source: bool = False,
) -> None:
    """Concatenate text files in another encoding; each file's heading is left out once.

    ``keep_source`` adds the file of each row, as the order of files is not kept.
    """
    df = read_text_files(spark, source, options, file_column="source_file" if keep_source else None)
    write_text(df, target, options.sep, encoding, quoting=options.quoting)


def recode_lines(
    spark: SparkSession, source: str | Sequence[str], target: str, options: TextOptions, encoding: str = "utf-8"
) -> None:
    """Concatenate text files in another encoding, each line as it stands; no field is parsed.

    Lines are decoded and encoded whole, so stray quotes, surplus separators and blanks come out
    as they went in. Each file's first line, its heading, is dropped by its place in the task that
    reads it, and each part file written starts with the heading. All files must share one
    heading; files with others are refused by name, as their lines cannot go under it.
    """
    from pyspark.sql import functions as F

    from tallywright.sources.readers import WHOLE_LINE_SEP, _whole_lines

    firsts = (
        _whole_lines(spark, source, options, header=False)
        .where(F.col("_start") == 0)
        .groupBy("_file")
        .agg(F.min_by("_line", "_order").alias("_heading"))
    )
    headings = firsts.groupBy("_heading").agg(F.min("_file").alias("_file")).take(2)
    if len(headings) != 1:
        raise ValueError(f"files with different headings cannot share one: {[r['_file'] for r in headings]}")
    lines = _whole_lines(spark, source, options, header=True).select(F.col("_line").alias(headings[0]["_heading"]))
    (
        lines.write.option("header", True)
        .option("sep", WHOLE_LINE_SEP)
        .option("quote", "")
        .option("escape", "\\")
        .option("encoding", charset(encoding))
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(target)
    )


def append_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    properties: Mapping[str, str],
    batch_size: int = 10_000,
    connections: int = 8,
) -> None:
    """Append to a database table in batches, over at most ``connections`` connections.

    User and password come in ``properties``; nothing is read from elsewhere.
    """
    # The writer would coalesce, and so run all that comes before it in that few tasks.
    (
        df.repartition(connections)
        .write.format("jdbc")
        .mode("append")
        .options(**dict(properties))
        .option("url", url)
        .option("dbtable", table)
        .option("batchsize", batch_size)
        .option("numPartitions", connections)
        .save()
    )
