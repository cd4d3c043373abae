"""Operators for preparing training text: joins, deduplication, filters, tokens and formats."""
