"""Small frames and brute-force results for the tests."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd

LEDGER_DDL = (
    "account_code string, account_name string, year_label string, fiscal_month int, "
    "counterparty string, journal_no string, line_no int, posting_date date, line_text string, "
    "amount decimal(18,2)"
)


def money(value) -> Decimal | None:
    return None if value is None else Decimal(str(value)).quantize(Decimal("0.01"))


def ledger(spark, rows):
    """Rows of (account, year, month, counterparty, amount); journals are numbered."""
    full = [
        (acct, f"name {acct}", year, month, party, str(i), 1, None, f"text {i}", money(amount))
        for i, (acct, year, month, party, amount) in enumerate(rows)
    ]
    return spark.createDataFrame(full, LEDGER_DDL)


def records(df, *columns):
    """Rows as sorted tuples with decimals as floats."""
    picked = df.select(*columns) if columns else df
    rows = [
        tuple(float(v) if isinstance(v, Decimal) else v for v in row) for row in picked.collect()
    ]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def brute_corridor(gl: pd.DataFrame, account: str, ctt: float) -> pd.DataFrame:
    """Corridor of one account, worked out month by month."""
    out = []
    mine = gl[gl.account_code == account]
    cells = {
        (y, m): round(sum(mine[(mine.year_label == y) & (mine.fiscal_month == m)].amount), 2)
        for y in ("CY", "PY")
        for m in range(1, 13)
    }
    moved = pd.Series([v for v in cells.values() if v != 0], dtype="float64")
    mean, std = moved.mean(), moved.std()
    std = 0.0 if pd.isna(std) else std
    upper, lower = mean + 2 * std, mean - 2 * std

    def flag(value):
        if abs(value) <= ctt:
            return "X"
        return "X" if lower < value < upper else "O"

    for m in range(1, 13):
        cy, py = cells["CY", m], cells["PY", m]
        out.append((m, cy, py, upper, lower, flag(cy), flag(py)))
    return pd.DataFrame(out, columns="month cy py upper lower cy_flag py_flag".split())
