"""Continuous reconciliation."""
