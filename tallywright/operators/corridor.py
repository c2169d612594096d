"""Corridor of usual monthly movements and the months outside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators.totals import month_spine
from tallywright.schema import ACCOUNT
from tallywright.settings import CURRENT, PRIOR, Settings


def usual_movement() -> tuple[Column, Column]:
    """Mean and sample deviation of the months that moved, both years pooled.

    A single month has deviation 0; no month at all leaves both null. The mean is an exact
    decimal sum over a count, so it does not depend on the order of rows.
    """
    moved = F.when(F.col("amount") != 0, F.col("amount"))
    mean = F.try_divide(F.sum(moved).cast("double"), F.count(moved))
    spread = F.stddev_samp(moved.cast("double"))
    deviation = F.when(F.count(moved) > 0, F.coalesce(spread, F.lit(0.0)))
    return mean.alias("mean"), deviation.alias("std")


def movement_statistics(monthly: DataFrame) -> DataFrame:
    """Mean and deviation per account."""
    return monthly.groupBy(*ACCOUNT).agg(*usual_movement())


def _flag(amount: Column, settings: Settings) -> Column:
    inside = (amount.cast("double") < F.col("upper")) & (amount.cast("double") > F.col("lower"))
    return (
        F.when(F.abs(amount) <= F.lit(settings.ctt), "X").when(inside, "X").otherwise("O")
    )


def corridor(monthly: DataFrame, settings: Settings) -> DataFrame:
    """Twelve months per account with both years, the bounds and a flag per year.

    A month is flagged ``O`` when its size is above ``ctt`` and it is not strictly inside
    mean ± z deviations.
    """
    spread = F.lit(settings.z) * F.col("std")
    return (
        month_spine(monthly, *usual_movement())
        .withColumns({"upper": F.col("mean") + spread, "lower": F.col("mean") - spread})
        .withColumns(
            {
                "cy_flag": _flag(F.col("cy"), settings),
                "py_flag": _flag(F.col("py"), settings),
            }
        )
        .drop("mean", "std")
    )


def abnormal_months(corridor_rows: DataFrame) -> DataFrame:
    """Account and month pairs flagged in either year."""
    return corridor_rows.filter(
        (F.col("cy_flag") == "O") | (F.col("py_flag") == "O")
    )


def abnormal_month_totals(corridor_rows: DataFrame) -> DataFrame:
    """One row per abnormal month and year, with the year's total of that month."""
    years = F.array(
        *(
            F.struct(F.lit(label).alias("year_label"), F.col(name).alias("month_total"))
            for label, name in ((CURRENT, "cy"), (PRIOR, "py"))
        )
    )
    return abnormal_months(corridor_rows).select(*ACCOUNT, "fiscal_month", F.inline(years))
