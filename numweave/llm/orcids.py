"""Token ids in ORC files, in ascending order of the document id.

Documents are dealt into ranges of their id, sorted, encoded and written with
integer run-length encoding, a row index and a Bloom filter on the id. Each
stripe stands alone, so files are read stripe by stripe in parallel, and
lookups by id skip stripes by their statistics and Bloom filters.

Columns of the files: the id column, part (number of the range), local (ids of
the range's documents before this one), n_tokens, ids. Null texts are a lone
end id; null ids come first; documents with equal ids keep any order among
themselves, each with its own row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import with_offsets
from .tokens import encode_documents

ROW_INDEX_STRIDE = 1000        # rows per row-index entry: one Bloom filter each
STRIPE_BYTES = 16 << 20


def write(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", added: bool = False) -> None:
    ordered = docs.select(key, text).repartitionByRange(F.col(key).asc()).sortWithinPartitions(F.col(key).asc())
    (encode_documents(ordered, tokenizer_path, 0, key, text, added).write
     .option("compression", "zstd")
     .option("orc.stripe.size", str(STRIPE_BYTES))
     .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
     .option("orc.bloom.filter.columns", key)
     .option("orc.bloom.filter.fpp", "0.01")
     .orc(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, n_tokens, ids, begin (ids of all documents before it)."""
    return with_offsets(spark.read.orc(path))


def find(spark: SparkSession, path: str, keys: list, key: str = "doc_id") -> DataFrame:
    """Rows of some documents; the filter reaches the ORC reader, which skips
    files, stripes and row groups by statistics and Bloom filters."""
    return spark.read.orc(path).where(F.col(key).isin(list(keys)))


def checksums(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            cut = lists.offsets.to_numpy().astype(np.int64)
            raw = memoryview(lists.flatten().to_numpy().astype("<u4").tobytes())
            cut = (4 * (cut - cut[0])).tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(np.diff(lists.offsets.to_numpy()).astype(np.int64)),
                pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cut, cut[1:])], pa.int64()),
            ], names=["key", "start", "n_tokens", "ids_crc32"])

    kind = rows.schema[key].dataType.simpleString()
    return (rows.select(rows[key].alias("key"), "ids", "begin")
            .mapInArrow(run, f"key {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
            .withColumnRenamed("key", key))
