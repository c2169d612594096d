"""Account, month and counterparty totals of a ledger.

:func:`monthly_totals` is the base of nearly all results: one partially aggregated
shuffle takes the ledger down to at most 12 x years rows per account, and what follows
works on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.schema import ACCOUNT
from tallywright.settings import CURRENT, MONTHS, PRIOR, YEARS


def total_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def _when_year(label: str) -> Column:
    return F.when(F.col("year_label") == label, F.col("amount"))


def account_totals(gl: DataFrame) -> DataFrame:
    return gl.groupBy(*ACCOUNT).agg(total_or_zero(F.col("amount")).alias("amount"))


def account_year_totals(gl: DataFrame) -> DataFrame:
    """One row per account and year; rows without a year are left out."""
    return (
        gl.filter(F.col("year_label").isNotNull())
        .groupBy(*ACCOUNT, "year_label")
        .agg(total_or_zero(F.col("amount")).alias("amount"))
    )


def account_year_pivot(gl: DataFrame) -> DataFrame:
    """One row per account with the current and the prior year as columns."""
    return (
        gl.filter(F.col("year_label").isin(*YEARS))
        .groupBy(*ACCOUNT)
        .agg(F.sum(_when_year(CURRENT)).alias("cy"), F.sum(_when_year(PRIOR)).alias("py"))
    )


def monthly_totals(gl: DataFrame, last_period: int = 12) -> DataFrame:
    """One row per account, fiscal period and year (current and prior).

    Periods run from 1 to ``last_period``: the twelve months, or 16 to keep closing periods.
    """
    return (
        gl.filter(F.col("year_label").isin(*YEARS) & F.col("fiscal_month").between(1, last_period))
        .groupBy(*ACCOUNT, "fiscal_month", "year_label")
        .agg(total_or_zero(F.col("amount")).alias("amount"))
    )


def left_out_lines(gl: DataFrame) -> DataFrame:
    """Lines that month reports cannot show, by reason, with their number and amount."""
    year, month = F.col("year_label"), F.col("fiscal_month")
    reason = (
        F.when(year.isNull(), "no year")
        .when(~year.isin(*YEARS), "other year")
        .when(month.isNull(), "no month")
        .when(~month.between(1, 12), "other month")
    )
    return (
        gl.withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("line_count"), total_or_zero(F.col("amount")).alias("amount"))
    )


def account_month_pivot(monthly: DataFrame) -> DataFrame:
    """One row per account and month that occurs, both years as columns."""
    return monthly.groupBy(*ACCOUNT, "fiscal_month").agg(
        total_or_zero(_when_year(CURRENT)).alias("cy"), total_or_zero(_when_year(PRIOR)).alias("py")
    )


def month_spine(monthly: DataFrame, *measures: Column) -> DataFrame:
    """Twelve rows per account with ``cy`` and ``py``; months without lines are 0.

    Built from one row per account that holds all 24 totals, so there is neither a spine
    table nor a join. ``measures`` are further aggregates to carry on every row.
    """
    cells = {f"{y}_{m}": (y, m) for y in YEARS for m in MONTHS}
    # Written as SQL text: two dozen conditional sums are slow to build call by call.
    wide = monthly.groupBy(*ACCOUNT).agg(
        *(
            F.expr(
                f"coalesce(sum(amount) FILTER (WHERE year_label = '{y}' AND fiscal_month = {m}),"
                f" 0) AS {name}"
            )
            for name, (y, m) in cells.items()
        ),
        *measures,
    )
    carried = [c for c in wide.columns if c not in cells]
    rows = ", ".join(f"{m}, {CURRENT}_{m}, {PRIOR}_{m}" for m in MONTHS)
    return wide.selectExpr(*carried, f"stack({len(MONTHS)}, {rows}) AS (fiscal_month, cy, py)")


def counterparty_totals(gl: DataFrame) -> DataFrame:
    """Per account, month and counterparty: both years, their difference and its size.

    Rows without month or counterparty are left out.
    """
    return (
        gl.filter(
            F.col("year_label").isin(*YEARS)
            & F.col("fiscal_month").isNotNull()
            & F.col("counterparty").isNotNull()
        )
        .groupBy(*ACCOUNT, "fiscal_month", "counterparty")
        .agg(
            total_or_zero(_when_year(CURRENT)).alias("cy"),
            total_or_zero(_when_year(PRIOR)).alias("py"),
        )
        .withColumn("difference", F.col("cy") - F.col("py"))
        .withColumn("abs_difference", F.abs("difference"))
    )


def months_present(gl: DataFrame) -> DataFrame:
    """Months that occur in the current year, ascending, without null."""
    return (
        gl.filter((F.col("year_label") == CURRENT) & F.col("fiscal_month").isNotNull())
        .select("fiscal_month")
        .distinct()
        .orderBy("fiscal_month")
    )
