"""Specifications, and what they compile to."""
