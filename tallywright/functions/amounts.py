"""Parsing and sign handling of amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.schema import MONEY, WIDE

#: How an extract writes negative numbers.
PLAIN = "plain"
PARENTHESES = "parentheses"
TRAILING_MINUS = "trailing_minus"

#: Blank characters taken off both ends of an amount, incl. no-break and ideographic space.
BLANKS = " \t\n\r\f\v\u0085\u00a0\u2002\u2003\u2009\u3000"


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def to_amount(value: Column, bad_as_zero: bool = False) -> Column:
    """Number from text: null becomes 0; unreadable text null, or 0 with ``bad_as_zero``.

    All digits are kept; :func:`settled` rounds to money, once, after signs and scales.
    """
    text = F.coalesce(value.cast("string"), F.lit("0"))
    parsed = F.btrim(text, F.lit(BLANKS)).try_cast(WIDE)
    return F.coalesce(parsed, zero()) if bad_as_zero else parsed


def parse_erp_amount(value: Column, negative: str = PLAIN) -> Column:
    """Number from ERP text with digit grouping and a chosen mark of negatives.

    Null and a lone ``-`` are 0. ``PARENTHESES`` reads ``(123)`` as -123,
    ``TRAILING_MINUS`` reads ``123-`` as -123. Unreadable text becomes null.

    ``value`` is mentioned several times, so it should be a column and not a costly
    expression.
    """
    text = _without(F.btrim(F.coalesce(value.cast("string"), F.lit("0")), F.lit(BLANKS)), ",")
    number = F.when(text == "-", F.lit("0"))
    if negative == PARENTHESES:
        number = number.otherwise(F.replace(_without(text, ")"), F.lit("("), F.lit("-")))
    elif negative == TRAILING_MINUS:
        moved = F.concat(F.lit("-"), _without(text, "-"))
        number = number.when(text.endswith("-"), moved).otherwise(text)
    elif negative == PLAIN:
        number = number.otherwise(text)
    else:
        raise ValueError(f"unknown negative format {negative!r}")
    return number.try_cast(WIDE)


def _without(text: Column, sign: str) -> Column:
    return F.replace(text, F.lit(sign), F.lit(""))


def strict_amount(value: Column) -> Column:
    """Amount from text with digit grouping; text that is no amount fails the query.

    So does a number with more digits than an amount has.
    """
    parsed = F.btrim(_without(value, ","), F.lit(BLANKS)).try_cast(WIDE)
    refused = F.raise_error(F.concat(F.lit("not a number of at most two decimals: "), value)).cast(MONEY)
    exact = F.when(~changed_by_settling(parsed), settled(parsed))
    return F.coalesce(exact, F.when(value.isNotNull(), refused))


def settled(amount: Column) -> Column:
    """Round to money, half up; null if it is too large."""
    return amount.try_cast(MONEY)


def changed_by_settling(amount: Column) -> Column:
    """Whether the amount has more digits than money can hold. False for null."""
    return amount.isNotNull() & ~amount.eqNullSafe(settled(amount))


def scale_hundred(amount: Column) -> Column:
    """Undo an ERP's currency shift of two digits."""
    return (amount.cast(WIDE) * F.lit(100)).cast(WIDE)


def sign_by_marker(
    amount: Column, marker: Column, debit: str = "S", null_is_debit: bool = False
) -> Column:
    """Keep the sign where the marker says debit, negate it elsewhere.

    A missing marker negates, unless ``null_is_debit``.
    """
    known = F.coalesce(marker, F.lit(debit if null_is_debit else ""))
    return F.when(known == debit, amount).otherwise(-amount)
