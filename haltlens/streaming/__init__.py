"""Structured Streaming version of the stop decision."""
