"""Joins of ledgers with document headers and account dimensions.

No side is hinted as broadcast: whether it is small is for Spark to check, from the
statistics at planning time and from the shuffled size at run time. Left joins on a hot
key are split by the skew settings in ``session.SESSION_CONF``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.codes import canonical_code
from tallywright.operators.mapping import column
from tallywright.schema import MAP_COLUMNS


def attach_headers(
    lines: DataFrame,
    headers: DataFrame,
    keys: Sequence[str] = ("journal_no",),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Line items with their document headers; exact copies of a header count once.

    Headers that repeat a key with other content multiply lines: see
    :func:`tallywright.operators.checks.repeated_keys`.
    """
    keys = list(keys)
    wanted = keys + [
        c for c in (columns if columns is not None else headers.columns) if c not in keys
    ]
    unique = headers.select(*(column(c) for c in wanted)).dropDuplicates()
    return lines.join(unique, keys, "left")


def repeated_map_codes(account_map: DataFrame) -> DataFrame:
    """Codes that a map has more than once in one spelling: rows, and different contents."""
    extra = [c for c in MAP_COLUMNS if c != "detail_code" and c in account_map.columns]
    return (
        account_map.filter(F.col("detail_code").isNotNull())
        .groupBy(canonical_code(F.col("detail_code")).alias("detail_code"))
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.size(F.collect_set(F.struct(*extra))).alias("variants"),
        )
        .filter(F.col("row_count") > 1)
    )


def unique_accounts(account_map: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per account code of a map, in its canonical spelling.

    Rows without a code are no accounts. Exact copies count once. A code whose rows differ fails the query by name, as it would
    multiply ledger lines (:func:`repeated_map_codes` lists such codes).
    """
    content = F.struct(*columns)
    code = canonical_code(F.col("detail_code")).alias("detail_code")
    found = (
        account_map.filter(F.col("detail_code").isNotNull())
        .groupBy(code)
        .agg(F.min(content).alias("low"), F.max(content).alias("high"))
    )
    refused = F.raise_error(F.concat(F.lit("the account map has different rows for "), "detail_code"))
    checked = F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).otherwise(
        refused.cast(found.schema["low"].dataType)
    )
    # A code that Spark does not know as the grouped one: the account-sized map is then shuffled
    # for the join by itself, which lets Spark split hot accounts on the other side.
    anew = F.concat("detail_code", F.lit("")).alias("detail_code")
    return found.select(anew, checked.alias("row")).select(
        "detail_code", *(F.col("row").getField(c).alias(c) for c in columns)
    )


def attach_account_map(
    df: DataFrame, account_map: DataFrame, code: str = "account_code"
) -> DataFrame:
    """Add the map's columns by account code; both codes are brought to one spelling."""
    extra = [c for c in MAP_COLUMNS if c != "detail_code" and c in account_map.columns]
    dimension = unique_accounts(account_map, extra)
    facts = df.drop(*MAP_COLUMNS).withColumn(code, canonical_code(column(code)))
    return facts.join(dimension, facts[code] == dimension["detail_code"], "left")


def attach_account_names(
    df: DataFrame, account_map: DataFrame, code: str = "account_code"
) -> DataFrame:
    """Add only the account name by account code."""
    names = unique_accounts(account_map, ["detail_name"]).select(
        F.col("detail_code").alias(code), F.col("detail_name").alias("account_name")
    )
    return (
        df.drop("account_name").withColumn(code, canonical_code(column(code))).join(names, code, "left")
    )


def unmapped_accounts(
    df: DataFrame, account_map: DataFrame, code: str = "account_code"
) -> DataFrame:
    """Account codes without a mapped financial-statement line.

    Codes are made distinct first, so the join sees accounts and not ledger lines.
    """
    used = df.select(canonical_code(column(code)).alias("account_code")).distinct()
    mapped = account_map.filter(F.col("fs_name").isNotNull()).select(
        canonical_code(F.col("detail_code")).alias("account_code")
    )
    return used.join(mapped, "account_code", "left_anti")
