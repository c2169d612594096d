"""Ledgers derived from commerce tables, and queries over them with SQL counterparts."""
