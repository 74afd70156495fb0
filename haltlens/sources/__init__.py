"""Readers, writers, contracts, and adapter views over the driver's tables."""
