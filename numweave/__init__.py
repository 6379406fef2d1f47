"""numweave: numbers inside text and tables, prepared, encoded and scored as
Spark DataFrame jobs."""

from .config import NumberFormat  # noqa: F401

__version__ = "0.1.0"
