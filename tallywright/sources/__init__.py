"""Readers and writers of ledger extracts."""
