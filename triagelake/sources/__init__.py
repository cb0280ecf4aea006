"""Readers and writers of ledgers, labels, alert stores and published artifacts."""
