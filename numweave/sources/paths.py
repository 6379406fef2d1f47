"""Output locations: always below the shared folder the cluster names in
``spark.checkpoint.dir`` (never a machine-local temporary folder)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/numweave-{name}-{uuid.uuid4().hex}"
