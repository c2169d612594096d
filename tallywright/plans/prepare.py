"""Raw extracts to a standard ledger or trial balance."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallywright.functions.amounts import changed_by_settling, settled
from tallywright.functions.dates import FALLBACK_DATE
from tallywright.operators import cleansing
from tallywright.operators.checks import repeated_keys
from tallywright.operators.joins import attach_account_map, unmapped_accounts
from tallywright.operators.mapping import MapRule, apply_map, with_account_key
from tallywright.operators.scoping import comparative_columns
from tallywright.schema import BALANCES, LEDGER, MONEY, TRIAL_BALANCE, conform

Hook = Callable[[DataFrame], DataFrame]


def unchanged(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class LedgerRules:
    """Per-client choices in preparing a ledger.

    ``client_step`` runs on the mapped rows, ``final_step`` after the account map.
    """

    date_pattern: str = "yyyy-MM-dd"
    fallback_date: str = FALLBACK_DATE
    first_month: int = 1
    flags: Collection[str] = ()
    year_label: str | None = None
    bad_amount_as_zero: bool = False
    client_step: Hook = unchanged
    final_step: Hook = unchanged


@dataclass(frozen=True)
class Prepared:
    """Prepared rows and what is to be known about them.

    ``seen`` fills with the counts of :func:`defect_counts` when ``rows`` is written or read to
    its end, at no further pass; ``defects`` is the same as a query of its own. ``unmapped``
    lists accounts without a line, and ``repeated`` accounts that occur in several rows, which
    only a trial balance must not have. Both work on the written table as well:
    :func:`unmapped_in` takes the rows as read back.
    """

    rows: DataFrame
    unmapped: DataFrame
    defects: DataFrame
    seen: Observation
    repeated: DataFrame | None = None


def defect_counts(df: DataFrame, dates: bool, amounts: Sequence[str]) -> list[Column]:
    """Lines, lines with the fallback date, with an unreadable amount, with one that settling
    as money changes, and the sum of all settled amounts."""
    present = [F.col(c) for c in amounts if c in df.columns]
    unreadable = reduce(or_, (c.isNull() for c in present), F.lit(False))
    changed = reduce(or_, (changed_by_settling(c) for c in present), F.lit(False))
    defaulted = F.col("date_defaulted") if dates else F.lit(False)
    total = settled(F.col("amount")) if "amount" in df.columns else F.lit(None).cast(MONEY)
    return [
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(defaulted).alias("defaulted_dates"),
        F.count_if(unreadable).alias("unreadable_amounts"),
        F.count_if(changed).alias("changed_amounts"),
        F.coalesce(F.sum(total), F.lit(0)).alias("control_total"),
    ]


def unmapped_in(rows: DataFrame) -> DataFrame:
    """Account codes of prepared rows that have no statement line."""
    return rows.filter(F.col("fs_name").isNull()).select("account_code").distinct()


def prepare_ledger(
    raw: DataFrame, column_map: Sequence[MapRule], account_map: DataFrame, rules: LedgerRules
) -> Prepared:
    """Map, cleanse and classify one raw ledger extract.

    One narrow pass up to the account map; the map join is the only one.
    """
    mapped = apply_map(raw, column_map).transform(rules.client_step)
    typed = (
        mapped.transform(cleansing.default_counterparty)
        .withColumn("journal_no", F.col("journal_no").cast("string"))
        .transform(cleansing.coerce_amounts, bad_as_zero=rules.bad_amount_as_zero)
        .transform(
            cleansing.parse_posting_date,
            rules.date_pattern,
            rules.fallback_date,
            rules.first_month,
        )
        .transform(cleansing.apply_flags, rules.flags, rules.year_label)
    )
    counts, seen = defect_counts(typed, True, ("amount", "debit", "credit")), Observation()
    classified = attach_account_map(typed.observe(seen, *counts), account_map)
    if cleansing.NAME_FROM_MAP in rules.flags:
        classified = cleansing.name_from_map(classified)
    named = classified.withColumn("account_name", F.coalesce("account_name", F.lit("")))
    rows = with_account_key(named.transform(rules.final_step))
    kept = [*(r.tobe for r in column_map), "date_defaulted"]
    return Prepared(
        conform(rows, LEDGER, kept),
        unmapped_accounts(typed, account_map),
        typed.agg(*counts),
        seen,
    )


def prepare_trial_balance(
    raw: DataFrame,
    column_map: Sequence[MapRule],
    account_map: DataFrame,
    client_step: Hook = unchanged,
) -> Prepared:
    """Map and classify a raw trial balance; missing amounts are 0."""
    mapped = apply_map(raw, column_map).transform(client_step)
    filled = cleansing.fill_balances(mapped)
    counts, seen = defect_counts(filled, False, BALANCES), Observation()
    classified = attach_account_map(filled.observe(seen, *counts), account_map).withColumn(
        "account_name", F.coalesce("account_name", F.lit(""))
    )
    kept = [r.tobe for r in column_map]
    rows = comparative_columns(conform(with_account_key(classified), TRIAL_BALANCE, kept))
    return Prepared(
        rows,
        unmapped_accounts(filled, account_map),
        filled.agg(*counts),
        seen,
        repeated_keys(rows, ["account_code", "account_name"]),
    )


def join_years(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Ledgers of both years under each other; copies stay."""
    return current.unionByName(prior, allowMissingColumns=True)
