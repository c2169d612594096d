"""Ratios with the zero rules of the review."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def change_ratio(change: Column, base: Column) -> Column:
    """``change / base`` where a zero base gives 0 for no change and 1 for any change.

    Null when either side is null.
    """
    return (
        F.when(change.isNull() | base.isNull(), F.lit(None).cast("double"))
        .when((base == 0) & (change == 0), F.lit(0.0))
        .when(base == 0, F.lit(1.0))
        .otherwise(F.try_divide(change.cast("double"), base.cast("double")))
    )


def whole_millions(amount: Column) -> Column:
    """Amount in millions, cut toward zero."""
    return (amount / F.lit(1_000_000)).cast("bigint")
