"""Imports every query module so that the registry is complete."""

from . import q_collate, q_generate, q_io, q_metrics, q_runs, q_text, q_vector  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
