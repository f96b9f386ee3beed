"""Structured Streaming front ends: row-local operators run unchanged, statistics in complete mode, the near-sorted join with state."""
