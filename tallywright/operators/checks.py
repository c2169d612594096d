"""Completeness and consistency checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallywright.operators.mapping import column
from tallywright.schema import ACCOUNT


def control_total(gl: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of all signed amounts, which is to be 0; optionally per file, year, …"""
    return gl.groupBy(*by).agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("control_total"),
        F.count(F.lit(1)).alias("line_count"),
    )


def row_counts(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Number of rows per named stage."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("stage"), "row_count")
        for name, df in stages.items()
    ]
    return reduce(DataFrame.unionAll, counts)


def observe_rows(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count the rows that pass this point of a job, at no extra pass over the data."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("row_count")), seen


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the number of rows."""
    return (
        df.groupBy(*(column(k) for k in keys))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .filter(F.col("row_count") > 1)
    )


def ambiguous_fs_codes(tb: DataFrame) -> DataFrame:
    """Financial-statement codes with more than one name or BS/PL class."""
    return (
        tb.select("fs_code", "fs_name", "bs_pl")
        .distinct()
        .groupBy("fs_code")
        .agg(F.count(F.lit(1)).alias("variants"))
        .filter(F.col("variants") > 1)
    )


def reconcile(tb_movements: DataFrame, gl_totals: DataFrame) -> DataFrame:
    """Trial balance against ledger, per account and year.

    Both sides hold one row per account and year with ``amount``. Every account of either
    side is kept; ``difference`` is trial balance less ledger, a missing side counting 0.
    """
    keys = [*ACCOUNT, "year_label"]
    left = tb_movements.select(*keys, F.col("amount").alias("tb_amount"))
    right = gl_totals.select(*keys, F.col("amount").alias("gl_amount"))
    difference = F.coalesce("tb_amount", F.lit(0)) - F.coalesce("gl_amount", F.lit(0))
    status = (
        F.when(F.col("gl_amount").isNull(), "tb only")
        .when(F.col("tb_amount").isNull(), "gl only")
        .when(F.col("difference") == 0, "matched")
        .otherwise("differs")
    )
    return (
        left.join(right, keys, "full_outer")
        .withColumn("difference", difference)
        .withColumn("status", status)
    )
