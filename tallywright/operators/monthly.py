"""Month reports: net movement and month-end balance.

Reports show the twelve months of the fiscal year at least. Ledgers that post year-end
adjustments to closing periods after the twelfth (13 to 16 in most fiscal calendars) get a
column for each such period that holds postings, so that the last column still rolls forward
to the closing balance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.schema import ACCOUNT
from tallywright.settings import CURRENT, MONTHS

MONTH_COLUMNS = [f"m{month:02d}" for month in MONTHS]
#: Closing periods that may follow the twelve months (fixed values of the fiscal calendar).
CLOSING_PERIODS = (13, 14, 15, 16)


def column_of(period: int) -> str:
    return f"m{period:02d}"


def ledger_periods(monthly: DataFrame) -> tuple[int, ...]:
    """The twelve months and the closing periods that hold postings of the current year.

    One aggregate over ``fiscal_month``; its set can hold only the four closing periods, so
    the driver receives at most four numbers however large the ledger. Periods outside 1 to 16
    are not columns; ``totals.left_out_lines`` counts them.
    """
    closing = F.col("fiscal_month").between(CLOSING_PERIODS[0], CLOSING_PERIODS[-1])
    found = (
        monthly.filter((F.col("year_label") == CURRENT) & closing)
        .agg(F.array_sort(F.collect_set("fiscal_month")).alias("periods"))
        .first()
    )
    return (*MONTHS, *(found["periods"] if found and found["periods"] else ()))


def net_movement(monthly: DataFrame, periods: tuple[int, ...] = MONTHS) -> DataFrame:
    """Net movement of the current year per account, ``periods`` as columns, 0 where none."""
    return (
        monthly.filter(F.col("year_label") == CURRENT)
        .groupBy(*ACCOUNT)
        .agg(
            *(
                F.expr(f"coalesce(sum(amount) FILTER (WHERE fiscal_month = {m}), 0) AS {column_of(m)}")
                for m in periods
            )
        )
    )


def opening_balance() -> Column:
    """Prior balance; P&L accounts open at 0."""
    return F.when(F.col("bs_pl") == "BS", F.col("py")).otherwise(F.lit(0))


def join_trial_balance(monthly: DataFrame, tb: DataFrame, periods: tuple[int, ...] = MONTHS) -> DataFrame:
    """Movements and trial balance side by side; accounts of either side are kept."""
    return net_movement(monthly, periods).join(tb, ACCOUNT, "full_outer")


def balance_report(monthly: DataFrame, tb: DataFrame, periods: tuple[int, ...] = MONTHS) -> DataFrame:
    """Month-end balances: opening plus movements so far, one column per period of ``periods``.

    ``roll_diff`` is the closing balance less the last period and should be 0; with the twelve
    months alone it is the sum of what the ledger posted to closing periods.
    """
    joined = join_trial_balance(monthly, tb, periods).withColumn(
        "py", F.coalesce(opening_balance(), F.lit(0))
    )
    columns = [column_of(m) for m in periods]
    running = {
        name: " + ".join(["py", *(f"coalesce({m}, 0)" for m in columns[: i + 1])])
        for i, name in enumerate(columns)
    }
    kept = [c for c in tb.columns if c not in {*ACCOUNT, "cy", "py"}]
    return joined.selectExpr(
        *ACCOUNT,
        *kept,
        "py",
        *(f"{total} AS {name}" for name, total in running.items()),
        "cy",
        f"cy - ({running[columns[-1]]}) AS roll_diff",
    )


def period_balance_report(monthly: DataFrame, tb: DataFrame) -> DataFrame:
    """:func:`balance_report` over the periods of the ledger itself (:func:`ledger_periods`)."""
    return balance_report(monthly, tb, ledger_periods(monthly))


def running_balance(monthly: DataFrame, tb: DataFrame) -> DataFrame:
    """The same balances in long form, for the months in which an account moved.

    The window runs over at most 12 rows per account.
    """
    opening = tb.select(*ACCOUNT, opening_balance().alias("opening"))
    so_far = Window.partitionBy(*ACCOUNT).orderBy("fiscal_month")
    return (
        monthly.filter(F.col("year_label") == CURRENT)
        .join(opening, ACCOUNT, "left")
        .select(
            *ACCOUNT,
            "fiscal_month",
            F.col("amount").alias("movement"),
            (
                F.coalesce("opening", F.lit(0))
                + F.sum("amount").over(so_far.rowsBetween(Window.unboundedPreceding, 0))
            ).alias("balance"),
        )
    )
