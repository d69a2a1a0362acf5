"""Ledger analytics as plain DataFrame functions on Spark."""
