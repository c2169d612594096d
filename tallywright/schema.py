"""Declared schemas of the standard ledger, trial balance and maps.

Raw input is read as text and cast to these types; nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

#: What amounts are read and worked with before they are settled as :data:`MONEY`.
WIDE = T.DecimalType(38, 6)

#: Columns that identify one account, in the ledger and in the trial balance.
ACCOUNT = ["account_code", "account_name"]

#: Columns that an account map adds to a ledger or trial balance.
MAP_COLUMNS = ["detail_code", "detail_name", "fs_code", "fs_name", "bs_pl"]

BALANCES = ["closing", "prior_closing", "prior_same_period", "prior2_closing"]

TIERS = ["t1", "t2", "t3", "t4"]


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_TEXT = T.StringType()

LEDGER = _struct(
    ("journal_no", _TEXT),
    ("line_no", T.IntegerType()),
    ("posting_date", T.DateType()),
    ("year_label", _TEXT),
    ("fiscal_month", T.IntegerType()),
    ("counterparty", _TEXT),
    ("line_text", _TEXT),
    ("amount", MONEY),
    ("debit", MONEY),
    ("credit", MONEY),
    ("account_code", _TEXT),
    ("account_name", _TEXT),
    ("account_key", _TEXT),
    ("detail_code", _TEXT),
    ("detail_name", _TEXT),
    ("fs_code", _TEXT),
    ("fs_name", _TEXT),
    ("bs_pl", _TEXT),
)

TRIAL_BALANCE = _struct(
    ("account_code", _TEXT),
    ("account_name", _TEXT),
    ("account_key", _TEXT),
    *((name, MONEY) for name in BALANCES),
    ("bs_pl", _TEXT),
    ("fs_code", _TEXT),
    ("fs_name", _TEXT),
    *((name, _TEXT) for name in TIERS),
    ("control_reliance", _TEXT),
    ("risk_level", _TEXT),
)

ACCOUNT_MAP = _struct(*((name, _TEXT) for name in MAP_COLUMNS))


def _typed(value: Column, kind: T.DataType) -> Column:
    """Cast; an amount too large for its type becomes null instead of failing the job."""
    return value.try_cast(kind) if isinstance(kind, T.DecimalType) else value.cast(kind)


def conform(df: DataFrame, schema: T.StructType, keep: Iterable[str] = ()) -> DataFrame:
    """Project ``df`` onto ``schema``: declared order and types, absent columns null.

    Columns of ``keep`` that are in the data but not in the schema follow as they are.
    """
    present = set(df.columns)
    further = [c for c in dict.fromkeys(keep) if c in present and c not in schema.names]
    return df.select(
        *(
            _typed(F.col(f.name) if f.name in present else F.lit(None), f.dataType).alias(f.name)
            for f in schema.fields
        ),
        *(F.col("`" + c.replace("`", "``") + "`") for c in further),
    )
