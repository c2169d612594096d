"""Trial balance against ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.operators.checks import reconcile
from tallywright.operators.totals import account_year_totals
from tallywright.schema import ACCOUNT
from tallywright.settings import CURRENT, PRIOR, YEARS


def trial_balance_movements(tb: DataFrame) -> DataFrame:
    """Movement per account and year that the ledger of that year should sum to.

    A balance-sheet account moves from its opening to its closing balance, a P&L account
    from 0 to its balance for the period.
    """
    sheet = F.col("bs_pl") == "BS"
    current = F.col("closing") - F.when(sheet, F.col("prior_closing")).otherwise(F.lit(0))
    prior = F.when(sheet, F.col("prior_closing") - F.col("prior2_closing")).otherwise(
        F.col("prior_same_period")
    )
    years = F.array(
        F.struct(F.lit(CURRENT).alias("year_label"), current.alias("amount")),
        F.struct(F.lit(PRIOR).alias("year_label"), prior.alias("amount")),
    )
    return tb.select(*ACCOUNT, F.inline(years))


def reconciliation(tb: DataFrame, gl: DataFrame) -> DataFrame:
    """Difference and status per account and year, for accounts of either side."""
    totals = account_year_totals(gl.filter(F.col("year_label").isin(*YEARS)))
    return reconcile(trial_balance_movements(tb), totals)
