"""Operators: one module per family, each a function from frames to a frame."""
