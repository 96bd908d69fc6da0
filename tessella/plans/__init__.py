"""Helpers that shape physical plans: sessions, lineage cuts, batch sizes."""
