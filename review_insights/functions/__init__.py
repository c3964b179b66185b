"""Reusable Catalyst column expressions (text, numeric, labels, stop words)."""
