"""From abnormal months to counterparties and single journal lines.

Both drill-downs join the whole ledger with a table of at most 12 rows per account and year.
Hand in stored corridor rows or totals (``session.write_through``): Spark then knows their
size when it plans the join, sends them to the lines where they are small enough and does
not shuffle the ledger. Where it cannot know, it plans a sort-merge join and moves all lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.operators.corridor import abnormal_month_totals, abnormal_months
from tallywright.operators.ranking import first_per_group, rank_all, top_ranks
from tallywright.operators.totals import counterparty_totals
from tallywright.schema import ACCOUNT
from tallywright.settings import Settings

MONTH = [*ACCOUNT, "fiscal_month"]
MONTH_YEAR = [*MONTH, "year_label"]


def counterparty_drilldown(gl: DataFrame, corridor_rows: DataFrame) -> DataFrame:
    """Counterparties of abnormal months, ranked by the size of their change."""
    months = abnormal_months(corridor_rows).select(*MONTH)
    totals = counterparty_totals(gl.join(months, MONTH, "left_semi"))
    return rank_all(totals, MONTH, "abs_difference")


def month_totals(monthly: DataFrame) -> DataFrame:
    """Monthly totals in the shape the line drill-down joins."""
    return monthly.select(*MONTH_YEAR, F.col("amount").alias("month_total"))


def with_month_total(gl: DataFrame, totals: DataFrame) -> DataFrame:
    """Lines of the months in ``totals``, each with its month's total.

    The totals come aggregated, so no month has to pass through one task as it would in a
    window.
    """
    return gl.join(totals, MONTH_YEAR)


def contributing_lines(gl: DataFrame, totals: DataFrame, settings: Settings) -> DataFrame:
    """Lines that make up more than the contribution limit of their month's total.

    In a month that nets to 0 every line that is not 0 counts; its ratio is null.
    """
    amount, total = F.col("amount"), F.col("month_total")
    beyond = F.when(total == 0, amount != 0).otherwise(
        F.abs(amount) > F.abs(total) * F.lit(settings.contribution_limit)
    )
    return (
        with_month_total(gl, totals)
        .filter(beyond)
        .withColumns(
            {
                "explain_ratio": F.try_divide(amount.cast("double"), total.cast("double")),
                "abs_amount": F.abs(amount),
            }
        )
        .withColumn("contribution", F.abs("explain_ratio"))
    )


def top_lines(lines: DataFrame, settings: Settings) -> DataFrame:
    """Largest contributing lines per account, year and month; ties share a rank."""
    return top_ranks(lines, MONTH_YEAR, "abs_amount", settings.top_lines)


def line_drilldown(gl: DataFrame, corridor_rows: DataFrame, settings: Settings) -> DataFrame:
    """Largest contributing lines of the abnormal months.

    Ranking reads the contributing lines twice; a plan that wants the ledger read once stores
    them between :func:`contributing_lines` and :func:`top_lines`, as the review does.
    """
    return top_lines(contributing_lines(gl, abnormal_month_totals(corridor_rows), settings), settings)


def top_counterparty(ranked: DataFrame) -> DataFrame:
    """Counterparty with the largest change per abnormal month; lowest code on ties."""
    return first_per_group(
        ranked, MONTH, [F.desc("abs_difference"), F.asc("counterparty")]
    )


def top_line(lines: DataFrame) -> DataFrame:
    """Largest line per abnormal month over both years, in a fixed order on ties."""
    order = [F.desc("abs_amount")]
    ties = ["year_label", "journal_no", "line_no", "posting_date", "counterparty", "line_text"]
    order += [F.asc(c) for c in ties] + [F.desc("amount")]
    return first_per_group(lines, MONTH, order)
