"""Tables in the folder all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import ctypes
import uuid
from functools import reduce, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: later steps read committed
    files, so a lost executor costs no earlier work and every reader sees the
    same rows."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.__dict__["scratch_path"] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again; others are
    left alone."""
    for table in tables:
        path = table.__dict__.pop("scratch_path", None)
        if path:
            spark = table.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """name, made longer until df has no such column."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get at most this many rows at a time: texts can be long,
    and the default of 10,000 is meant for narrow rows. A smaller setting of
    the user's stays."""
    if int(spark.conf.get(ARROW_ROWS, "10000")) > rows:
        spark.conf.set(ARROW_ROWS, str(rows))


def lean(run):
    """A function for mapInArrow that, when its task ends, hands what the worker
    no longer needs back to the system: Spark keeps workers for later tasks,
    and each would go on holding the most that any task has needed."""
    @wraps(run)
    def through(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc has it
            if trim:
                trim(0)

    return through


BROADCAST_BYTES = 16 << 20     # a table sent to every executor is at most this large


def small(df: DataFrame, row_bytes: int) -> bool:
    """Whether df, counted, fits in BROADCAST_BYTES."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def fetched(rows: DataFrame, wanted: DataFrame, on: list[str], row_bytes: int = 32) -> DataFrame:
    """The rows that ``wanted`` names, with its columns; nulls in ``on`` match
    each other. A short list is sent to where the rows are; a longer one is
    joined by shuffling both. Either way the same rows come out."""
    wanted = written(wanted, "wanted")
    names = wanted.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in wanted.columns if c not in on])
    if small(wanted, row_bytes):
        names = F.broadcast(names)
    cond = reduce(lambda x, y: x & y, (rows[c].eqNullSafe(names[f"_{c}"]) for c in on))
    return rows.join(names, cond).drop(*[f"_{c}" for c in on])


def filtered(docs: DataFrame, judge, text: str = "text") -> DataFrame:
    """The rows of docs whose text ``judge`` keeps: judge(list of texts) gives
    one boolean each. Rows stay where they are; all columns pass through."""
    at = docs.columns.index(text)

    @lean
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
