"""Run-log source: log files -> ordered line table (inventory 2.1).

Two layouts are read:
* the training script's tree ``<base>/<method>/<run>/training_log_<ts>.log``
  (``recursiveFileLookup`` + ``pathGlobFilter``; the file path comes from the
  ``_metadata`` column), read line by line. A large file is read in splits by
  many tasks; ``numbered_lines`` gives every line its number in the file.
* a run-log table ``(path, line_no, line)`` in Parquet, the Spark-native
  store for many small logs (``write_run_log_table``): one columnar write
  instead of one committed file per log.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) of a text scan, line numbers from 0 per file.

    Every line is noted with its file, the place where its split begins, and a
    running number; these are pinned once, since another evaluation may split
    the files elsewhere. Lines per split are counted, prefix sums over the
    splits of a file say how many lines come before each, and a line's number
    is that plus its place in the split. An empty file has no lines; a last
    line end does not begin another line.
    """
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
                         F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")).checkpoint()
    splits = lines.groupBy("path", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)        # one row per split
    offsets = splits.select("path", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    return lines.join(offsets, ["path", "split"]).select("path", (F.col("at") + F.col("offset")).alias("line_no"), "line")


def src_run_logs(spark: SparkSession, root: str, glob: str = "*.log", relative: bool = True) -> DataFrame:
    lines = numbered_lines(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root))
    if not relative:
        return lines
    prefix = root.rstrip("/").split(":", 1)[-1] + "/"
    return lines.withColumn("path", F.regexp_replace("path", r"^.*?" + re.escape(prefix), ""))


def _folder_of(path: str | None) -> str:
    return "log_path=" + (quote(path, safe="") if path else "__HIVE_DEFAULT_PARTITION__")


def write_run_logs(lines: DataFrame, root: str, order_col: str = "line_no") -> None:
    """Line table -> one text file per log path (the training script's
    layout), lines in order. All lines of a log go to one task
    (hash-partitioned by path) and are sorted there. Use for export, not as a
    store.

    The task writes a log as a hidden file of its own and, once whole, renames
    it to the log's one name: another attempt puts the same lines there, and no
    job end has to move file after file. An earlier tree in ``root`` goes."""

    def write(batches):
        files, base = FileSystem.from_uri(root)
        current, out, hidden = None, None, None

        def close():
            out.close()
            files.move(hidden, f"{hidden.rsplit('/', 1)[0]}/part-0.txt")

        for batch in batches:
            for path, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = f"{base}/{_folder_of(path)}"
                if folder != current:
                    if out is not None:
                        close()
                        yield pa.RecordBatch.from_pydict({"folder": [current]})
                    files.create_dir(folder, recursive=True)
                    current, hidden = folder, f"{folder}/.{uuid.uuid4().hex}"
                    out = files.open_output_stream(hidden, buffer_size=1 << 16)
                out.write(((line or "") + "\n").encode())
        if out is not None:
            close()
            yield pa.RecordBatch.from_pydict({"folder": [current]})

    files, base = FileSystem.from_uri(root)
    if files.get_file_info(base).type != FileType.NotFound:
        files.delete_dir_contents(base)
    files.create_dir(base, recursive=True)
    (lines.repartition("path").sortWithinPartitions("path", order_col).select("path", "line")
     .mapInArrow(write, "folder string").agg(F.count("folder")).collect())


def read_written_logs(spark: SparkSession, root: str) -> DataFrame:
    """The logs ``write_run_logs`` wrote: the path is the one in the table."""
    lines = numbered_lines(spark.read.option("recursiveFileLookup", "true").text(root))
    return lines.withColumn("path", F.url_decode(F.url_decode(F.regexp_extract("path", "log_path=([^/]+)/", 1))))


def write_run_log_table(lines: DataFrame, root: str, order_col: str = "line_no") -> None:
    """Line table with 0-based line numbers per log, as Parquet. Line numbers
    are a rank inside each log (a window per log file: groups are single
    files, so no task holds more than one log's lines per group)."""
    w = Window.partitionBy("path").orderBy(order_col)
    (lines.select("path", (F.row_number().over(w) - 1).cast("bigint").alias("line_no"), "line")
     .write.mode("overwrite").parquet(root))


def read_run_log_table(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).select("path", "line_no", "line")
