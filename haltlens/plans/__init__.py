"""Registered queries, each an operator applied to an adapter view, with a DuckDB counterpart."""
