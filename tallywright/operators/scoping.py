"""Comparative balances, materiality and the selection of accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.ratios import change_ratio
from tallywright.operators.totals import total_or_zero
from tallywright.settings import Settings


def comparative_columns(tb: DataFrame) -> DataFrame:
    """``cy``, ``py`` and ``py1``; the prior balance of a P&L account is the same period's."""
    return tb.withColumns(
        {
            "cy": F.col("closing"),
            "py": F.when(F.col("bs_pl") == "BS", F.col("prior_closing")).otherwise(
                F.col("prior_same_period")
            ),
            "py1": F.col("prior2_closing"),
        }
    )


def change_columns(tb: DataFrame) -> DataFrame:
    """Change in amount and as a ratio of the prior balance."""
    change = F.col("cy") - F.col("py")
    return tb.withColumn("change_amount", change).withColumn(
        "change_ratio", change_ratio(F.col("change_amount"), F.col("py"))
    )


def threshold(cy: Column, settings: Settings) -> Column:
    """Smaller of a share of the balance and a share of performance materiality."""
    return F.when(
        cy.isNotNull(),
        F.least(
            F.abs(cy) * F.lit(settings.balance_share), F.lit(settings.pm) * F.lit(settings.pm_share)
        ),
    )


def scope_flag(settings: Settings) -> Column:
    """``O`` for accounts to analyse, ``X`` for the others."""
    size = F.abs("change_amount")
    return (
        F.when(size <= F.lit(settings.ctt), "X")
        .when(
            (size >= F.col("threshold")) | (F.abs("change_ratio") >= F.lit(settings.ratio_limit)),
            "O",
        )
        .otherwise("X")
    )


def scope(tb: DataFrame, settings: Settings) -> DataFrame:
    """Trial balance with change, threshold and scope flag per account."""
    return (
        change_columns(tb)
        .withColumn("threshold", threshold(F.col("cy"), settings))
        .withColumn("in_scope", scope_flag(settings))
    )


def accounts_in_scope(scoped: DataFrame) -> DataFrame:
    return (
        scoped.filter(F.col("in_scope") == "O")
        .select("account_key", "account_code", "account_name")
        .distinct()
    )


def _with_tier_total(tb: DataFrame, tier: str) -> DataFrame:
    """Sum of changes per tier on every row; null where the tier is null.

    Aggregated and joined back, not windowed, as one tier may hold most accounts.
    """
    totals = (
        tb.filter(F.col(tier).isNotNull())
        .groupBy(tier)
        .agg(total_or_zero(F.col("change_amount")).alias(f"{tier}_change"))
    )
    return tb.join(totals, tier, "left")


def explain_tiers(scoped: DataFrame) -> DataFrame:
    """Tier totals and how much of the upper level each lower level explains."""
    return (
        _with_tier_total(_with_tier_total(scoped, "t1"), "t2")
        .withColumn("t1_explain_ratio", change_ratio(F.col("t2_change"), F.col("t1_change")))
        .withColumn("t2_explain_ratio", change_ratio(F.col("change_amount"), F.col("t2_change")))
    )
