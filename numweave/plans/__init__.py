"""Registered queries (one per inventory key) with their DuckDB statements,
and the inputs derived from the given tables (``inputs.py``)."""
