"""Structured Streaming: the row-local operators run unchanged on a stream.

The reference has no streaming; the corpus-preparation path (extract, mask,
encode) is written with column expressions only, so a ``readStream`` source
can feed it and a ``writeStream`` sink can persist it. Operators that need a
global order (splits, batches) are batch-only. Metrics per micro-batch go
through ``foreachBatch`` so each batch is written exactly once per epoch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NumberFormat
from ..functions import text as T
from ..functions import vector as V
from ..sources.sinks import non_finite


def read_corpus_stream(spark: SparkSession, path: str, schema: str, max_files_per_trigger: int = 100) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path))


def stream_numbers(stream: DataFrame, key_cols, text_col: str, fmt: NumberFormat | None = None) -> DataFrame:
    """(keys, pos, raw, value[, vector]) per number of every arriving row."""
    keys = list(key_cols)
    out = (stream.select(*keys, F.posexplode(T.number_strings(text_col)).alias("pos", "raw"))
           .withColumn("value", F.col("raw").cast("double")))
    if fmt is not None:
        out = out.withColumn("vector", V.periodic_features("value", list(fmt.periods), fmt.dim))
    return out


def stream_masked(stream: DataFrame, key_cols, text_col: str) -> DataFrame:
    """(keys, masked, tokens, numbers) per arriving row."""
    return stream.select(*key_cols, T.mask_numbers(text_col).alias("masked"),
                         T.tokenize(T.mask_numbers(text_col)).alias("tokens"),
                         T.extract_numbers(text_col).alias("numbers"))


def start_parquet_sink(df: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """Append to Parquet with a checkpoint location (exactly-once file sink)."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.outputMode("append").start()


def quarantine_batches(cols, good_path: str, bad_path: str):
    """foreachBatch function: finite rows to ``good_path``, the rest to
    ``bad_path``; the epoch id makes a replayed batch overwrite its own
    output instead of duplicating it."""
    def handle(batch: DataFrame, epoch_id: int) -> None:
        bad = non_finite(cols)
        batch.filter(bad).write.mode("overwrite").parquet(f"{bad_path}/epoch={epoch_id}")
        batch.filter(~F.coalesce(bad, F.lit(False))).write.mode("overwrite").parquet(f"{good_path}/epoch={epoch_id}")

    return handle
