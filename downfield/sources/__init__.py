"""Datasets, readers, stored tables and the load ledger."""
