"""Operators for large text corpora (tokens, archives, quality, duplicates).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
