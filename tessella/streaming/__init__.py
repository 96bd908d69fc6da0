"""Structured Streaming extension; the reference pipeline has none."""
