"""Query registry: every operator of the inventory is registered once with
its Spark plan (spark, sf_dir) -> DataFrame and, where SQL can express it, an
independent DuckDB statement over the same tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a table; a scan with fewer splits than the cluster's parallelism
    (one small file, one row group) is spread round-robin so the per-row work
    that follows (regex, hashing, encoding) uses every core. At scale the scan
    already has thousands of splits and nothing is added."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df)


def spread(df: DataFrame) -> DataFrame:
    try:
        parallelism = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD access (e.g. a Connect session): leave the scan as is
        return df
    if splits < parallelism:
        return df.repartition(parallelism)
    return df
