"""Account codes and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character number of "9"; blanks, signs and digits come before it, letters after.
LAST_DIGIT = 57


def canonical_code(code: Column) -> Column:
    """One spelling per account code.

    Numeric text becomes integer text (``00123`` and ``123.0`` are both ``123``, digits
    after the point are cut), other text stays, null becomes ``0``.
    """
    text = code.cast("string")
    number = text.try_cast("decimal(38,10)").try_cast("bigint").cast("string")
    # Text that starts with a letter is no number; a failed cast costs far more than the look.
    return F.coalesce(F.when(F.ascii(text) <= LAST_DIGIT, number), text, F.lit("0"))


def account_key(code: Column, name: Column) -> Column:
    """``code_name``; a missing part counts as empty."""
    return F.concat_ws("_", F.coalesce(code, F.lit("")), F.coalesce(name, F.lit("")))


def file_label(text: Column) -> Column:
    """Text that is safe in a file name."""
    return F.translate(text, "/:<>", "____")
