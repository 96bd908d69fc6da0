"""Tessella: aligning, profiling and evaluating measurement tables with PySpark."""
