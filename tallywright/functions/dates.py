"""Posting dates and fiscal months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date that stands for an unreadable posting date.
FALLBACK_DATE = "2022-01-01"


def parsed_date(value: Column, pattern: str) -> Column:
    """Date by ``pattern``; null where the text does not fit."""
    return F.try_to_timestamp(value.cast("string"), F.lit(pattern)).cast("date")


def posting_date(value: Column, pattern: str, fallback: str = FALLBACK_DATE) -> Column:
    """Date by ``pattern``; unreadable or missing dates become ``fallback``."""
    return F.coalesce(parsed_date(value, pattern), F.lit(fallback).cast("date"))


def fiscal_month(date: Column, first_month: int = 1) -> Column:
    """Month of the fiscal year, 1..12; the year starts in calendar month ``first_month``."""
    if first_month == 1:
        return F.month(date)
    return (F.pmod(F.month(date) - F.lit(first_month), F.lit(12)) + 1).cast("int")
