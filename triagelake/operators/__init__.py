"""Operators over ledgers, rule rows and alerts."""
