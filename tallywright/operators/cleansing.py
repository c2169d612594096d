"""Cleansing of mapped ledger and trial-balance rows."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallywright.functions import amounts, dates
from tallywright.functions.codes import canonical_code
from tallywright.operators.mapping import column
from tallywright.schema import BALANCES, WIDE

Step = Callable[[DataFrame], DataFrame]

STAMP_YEAR = "stamp_year"
NEGATE_CREDIT = "negate_credit"
SPLIT_AMOUNT = "split_amount"
COMPOSE_AMOUNT = "compose_amount"
NAME_FROM_MAP = "name_from_map"


def default_counterparty(df: DataFrame, default: str = "NA") -> DataFrame:
    return df.withColumn("counterparty", F.coalesce("counterparty", F.lit(default)))


def coerce_amounts(
    df: DataFrame,
    columns: Iterable[str] = ("amount", "debit", "credit"),
    bad_as_zero: bool = False,
) -> DataFrame:
    """Make amounts numeric: null is 0, unreadable text null (or 0)."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: _number(df, c, bad_as_zero) for c in present})


def _number(df: DataFrame, name: str, bad_as_zero: bool = False) -> Column:
    if isinstance(df.schema[name].dataType, NumericType):
        return F.coalesce(column(name).try_cast(WIDE), amounts.zero())
    return amounts.to_amount(column(name), bad_as_zero)


def stamp_year(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("year_label", F.lit(label))


def parse_posting_date(
    df: DataFrame, pattern: str, fallback: str = dates.FALLBACK_DATE, first_month: int = 1
) -> DataFrame:
    """Posting date and fiscal month; ``date_defaulted`` marks rows that took the fallback."""
    parsed = df.withColumn("_parsed", dates.parsed_date(F.col("posting_date"), pattern))
    return (
        parsed.withColumns(
            {
                "date_defaulted": F.col("_parsed").isNull(),
                "posting_date": F.coalesce("_parsed", F.lit(fallback).cast("date")),
            }
        )
        .withColumn("fiscal_month", dates.fiscal_month(F.col("posting_date"), first_month))
        .drop("_parsed")
    )


def negate_credit(df: DataFrame) -> DataFrame:
    return df.withColumn("credit", -F.col("credit"))


def split_amount(df: DataFrame) -> DataFrame:
    """Debit and credit from the signed amount; both are positive."""
    amount = F.col("amount")
    return df.withColumns(
        {
            "debit": F.greatest(amount, amounts.zero()),
            "credit": F.greatest(-amount, amounts.zero()),
        }
    )


def compose_amount(df: DataFrame) -> DataFrame:
    """Signed amount from debit and an already negative credit."""
    return df.withColumn("amount", F.col("debit") + F.col("credit"))


def name_from_map(df: DataFrame) -> DataFrame:
    return df.withColumn("account_name", F.col("detail_name"))


def apply_flags(df: DataFrame, flags: Collection[str], year_label: str | None = None) -> DataFrame:
    """Run the switched-on amount steps, in their fixed order."""
    if STAMP_YEAR in flags and year_label is None:
        raise ValueError("stamp_year needs a year label")
    steps: list[tuple[str, Step]] = [
        (STAMP_YEAR, lambda d: stamp_year(d, year_label)),
        (NEGATE_CREDIT, negate_credit),
        (SPLIT_AMOUNT, split_amount),
        (COMPOSE_AMOUNT, compose_amount),
    ]
    unknown = set(flags) - {name for name, _ in steps} - {NAME_FROM_MAP}
    if unknown:
        raise ValueError(f"unknown flags: {sorted(unknown)}")
    for name, step in steps:
        if name in flags:
            df = df.transform(step)
    return df


def canonical_accounts(df: DataFrame, code: str = "account_code") -> DataFrame:
    return df.withColumn(code, canonical_code(column(code)))


def drop_echoed_headers(df: DataFrame, field: str, header: str) -> DataFrame:
    """Remove rows in which a field repeats its own heading; null fields stay."""
    return df.filter(~column(field).eqNullSafe(F.lit(header)))


def in_period(date: Column, start: str, end: str) -> Column:
    """Condition for ``start <= date <= end``, both ISO dates.

    Compares a plain column with date literals, so it reaches a Parquet scan.
    """
    return date.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def period_filter(df: DataFrame, start: str, end: str, date: str = "posting_date") -> DataFrame:
    return df.filter(in_period(F.col(date), start, end))


def outside_period(df: DataFrame, start: str, end: str, date: str = "posting_date") -> DataFrame:
    """Count of rows the period filter leaves out, rows without a date included."""
    inside = F.coalesce(in_period(F.col(date), start, end), F.lit(False))
    return df.agg(
        F.count_if(inside).alias("rows_inside"), F.count_if(~inside).alias("rows_outside")
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def fill_balances(df: DataFrame, columns: Iterable[str] = BALANCES) -> DataFrame:
    """Missing trial-balance amounts are 0."""
    return df.withColumns({c: _number(df, c) for c in columns if c in df.columns})


def account_rows(df: DataFrame, code: str) -> DataFrame:
    """Rows of one account."""
    return df.filter(F.col("account_code") == code)


def distinct_values(df: DataFrame, field: str) -> DataFrame:
    return df.select(column(field)).distinct()
