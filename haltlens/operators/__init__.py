"""Operators: decisions, metrics, selection, tokens, rankings, splits, audits, parsing, features."""
