"""Ledgers as streams."""
