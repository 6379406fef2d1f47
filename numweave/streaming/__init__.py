"""Structured Streaming use of the row-local corpus operators."""
