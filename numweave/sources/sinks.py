"""Metric and quarantine sinks (inventory 2.1)."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


METRIC_BUCKETS = 64
FILE_ROWS = 1_000_000      # rows of a metrics file, about


def content_id(df: DataFrame) -> str:
    """A batch's name made of its rows: the same rows in any order give the same name."""
    h = F.xxhash64(*df.columns)
    n, a, b = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(38,0)"))).first()
    return f"{n}-{a or 0}-{b or 0}"


def sink_metrics(df: DataFrame, path: str, run_col: str = "run", batch_id: str | None = None) -> str:
    """Append a batch of epoch / stage metric records, once however often it is
    written; returns the batch's id.

    Each attempt writes its files under a name of its own and then one manifest
    record (batch, attempt, rows). ``read_metrics`` honours the first attempt
    the manifest holds for a batch, so a repeated or concurrent append of the
    same batch, or one that failed half-way, adds nothing. ``batch_id``: the
    caller's name of the batch (an epoch, a stream's batch number); by default
    it is made of the rows.

    Files lie in a bounded number of folders (a hash bucket of the run), rows of
    a run together; a bucket of many rows is dealt over several files.
    """
    spark = df.sparkSession
    batch_id = content_id(df) if batch_id is None else str(batch_id)
    if not _manifest(spark, path).filter(F.col("batch") == batch_id).isEmpty():
        return batch_id
    attempt = f"a-{uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64(run_col), F.lit(METRIC_BUCKETS)).cast("int")
    rows = df.withColumn("run_bucket", bucket)
    sizes = rows.groupBy("run_bucket").agg(F.count(F.lit(1)).alias("_n"))                        # METRIC_BUCKETS rows
    files = F.ceil(F.col("_n") / F.lit(FILE_ROWS)).cast("int")
    dealt = (rows.join(F.broadcast(sizes), "run_bucket").withColumn("_file", F.pmod(F.xxhash64(*df.columns), files))
             .repartition("run_bucket", "_file").sortWithinPartitions("run_bucket", run_col).drop("_n", "_file"))
    dealt.write.partitionBy("run_bucket").parquet(f"{path.rstrip('/')}/rows/attempt={attempt}")
    done = spark.createDataFrame([(batch_id, attempt, time.time())], MANIFEST)
    done.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/manifest")
    return batch_id


MANIFEST = "batch string, attempt string, written double"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """The attempt that counts for every batch: the first that was committed."""
    where = f"{path.rstrip('/')}/manifest"
    try:
        held = spark.read.schema(MANIFEST).parquet(where)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = spark.createDataFrame([], MANIFEST)
    return held.groupBy("batch").agg(F.min_by("attempt", F.struct("written", "attempt")).alias("attempt"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The records of all committed batches, each batch once."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/rows")
    return rows.join(_manifest(spark, path).select("attempt"), "attempt", "left_semi").drop("attempt", "run_bucket")


def non_finite(cols) -> "F.Column":
    checks = [F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf")) for c in cols]
    return reduce(lambda a, b: a | b, checks)


def sink_quarantine(df: DataFrame, cols, path: str) -> DataFrame:
    """One evaluation of df, written in two folders below ``path``:
    ``diverted=true`` holds rows with a non-finite value in ``cols``,
    ``diverted=false`` the others (NULL is not non-finite). Returns the latter."""
    bad = F.coalesce(non_finite(cols), F.lit(False))
    df.withColumn("diverted", bad).write.mode("append").partitionBy("diverted").parquet(path)
    return read_quarantine(df.sparkSession, path, df.schema, False)


def read_quarantine(spark, path: str, schema, diverted: bool = True) -> DataFrame:
    """The rows of one side; the schema is declared, so an empty side reads as an empty table."""
    full = StructType([*schema.fields, StructField("diverted", BooleanType())])
    return spark.read.schema(full).parquet(path).filter(F.col("diverted") == diverted).drop("diverted")
