"""Incremental intake of extracts."""
