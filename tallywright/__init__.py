"""Analytical review of general ledgers and trial balances on Spark."""

from tallywright.settings import DETAIL, FS_LINE, Settings

__all__ = ["DETAIL", "FS_LINE", "Settings"]
