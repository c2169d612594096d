"""Switch between account level and financial-statement-line level.

The switch only picks other key columns, so that every operator runs unchanged on either
level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.codes import canonical_code
from tallywright.operators.mapping import with_account_key
from tallywright.operators.totals import total_or_zero
from tallywright.schema import BALANCES, TIERS
from tallywright.settings import DETAIL, FS_LINE

#: Tier and risk values of a statement line, which has none of its own (fixed values).
LINE_DEFAULTS = {
    "t1": "T1",
    "t2": "T2",
    "t3": "T3",
    "t4": "T4",
    "control_reliance": "CR",
    "risk_level": "RL",
}


#: The line of all accounts that have none, in the ledger and in the trial balance.
UNMAPPED_CODE, UNMAPPED_NAME = "UNMAPPED", "not mapped to a line"


def _named_lines(df: DataFrame) -> DataFrame:
    """Give accounts without a line the one named line, which has no class."""
    mapped = F.col("fs_code").isNotNull() & F.col("fs_name").isNotNull()
    lines = {
        "fs_code": F.when(mapped, F.col("fs_code")).otherwise(UNMAPPED_CODE),
        "fs_name": F.when(mapped, F.col("fs_name")).otherwise(UNMAPPED_NAME),
    }
    if "bs_pl" in df.columns:
        lines["bs_pl"] = F.when(mapped, F.col("bs_pl"))
    return df.withColumns(lines)


def _key_by_line(df: DataFrame) -> DataFrame:
    return with_account_key(
        df.withColumns(
            {
                "account_code": canonical_code(F.col("fs_code")),
                "account_name": F.coalesce("fs_name", F.lit("")),
            }
        )
    )


def ledger_at_level(gl: DataFrame, level: str) -> DataFrame:
    """Ledger keyed by account, or by statement line."""
    if level == DETAIL:
        return gl
    if level == FS_LINE:
        return _key_by_line(_named_lines(gl))
    raise ValueError(f"unknown level {level!r}")


def statement_line_totals(tb: DataFrame) -> DataFrame:
    """Balances summed per statement line.

    Grouped by code, name and class together, which needs no join back to the accounts; a
    code with two names or classes gives two lines (see ``checks.ambiguous_fs_codes``).
    Accounts without a line make up one of their own.
    """
    return (
        _named_lines(tb)
        .groupBy("fs_code", "fs_name", "bs_pl")
        .agg(*(total_or_zero(F.col(b)).alias(b) for b in BALANCES))
    )


def trial_balance_at_level(tb: DataFrame, level: str) -> DataFrame:
    """Trial balance keyed by account, or rolled up to statement lines."""
    if level == DETAIL:
        return tb
    if level == FS_LINE:
        lines = _key_by_line(statement_line_totals(tb))
        return lines.withColumns({name: F.lit(v) for name, v in LINE_DEFAULTS.items()}).select(
            "account_code",
            "account_name",
            "account_key",
            *BALANCES,
            "bs_pl",
            "fs_code",
            "fs_name",
            *TIERS,
            "control_reliance",
            "risk_level",
        )
    raise ValueError(f"unknown level {level!r}")
