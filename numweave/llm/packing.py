"""Concatenate and cut: documents become one long stream of ids that is cut
into windows of a fixed size.

Two passes: the first writes every document's ids with its position inside its
partition and sums the ids per partition; prefix sums over those totals (one
row per partition) give each document's place in the whole stream. The second
cuts the documents at the window borders, partition by partition, without
moving any ids. Windows that span partitions are put together from boundary
records.

Null and empty texts are a lone end id. Repeated rows are documents of their
own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import lean, written
from .tokens import encode_documents

WINDOW = 1024


def stream(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", added: bool = False,
           packed: bool = False) -> DataFrame:
    """Documents with their ids and place in the stream: key, n_tokens, ids, begin.
    ``packed``: ids as binary, for ``pieces``."""
    return with_offsets(written(encode_documents(docs, tokenizer_path, 0, key, text, added, packed), "stream"))


def with_offsets(parts: DataFrame) -> DataFrame:
    """Adds begin = ids of all documents before this one, from (part, local).

    The window without partitions and the broadcast see one row per written
    partition.
    """
    totals = parts.groupBy("part").agg(F.max(F.col("local") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return (parts.join(F.broadcast(offsets), "part")
            .withColumn("begin", F.col("offset") + F.col("local")).drop("offset", "part", "local"))


def pieces(placed: DataFrame, window: int = WINDOW, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """The parts of documents between window borders: key, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, and, if asked for, ids."""
    packed = placed.schema["ids"].dataType.simpleString() == "binary"

    @lean
    def run(batches):
        for batch in batches:
            n, begin = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            base = np.concatenate([[0], np.cumsum(n)])
            if packed:
                raw = b"".join(batch.column(2).to_pylist())
                values = np.frombuffer(raw, "<u2" if len(raw) == 2 * base[-1] else "<u4").astype("<u4")
            else:
                values = batch.column(2).flatten().to_numpy().astype("<u4")
            first = begin // window
            count = np.where(n > 0, (begin + n - 1) // window - first + 1, 0)
            doc = np.repeat(np.arange(len(n)), count)
            seq = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            lo = np.maximum(seq * window, begin[doc])
            hi = np.minimum((seq + 1) * window, (begin + n)[doc])
            a = base[doc] + lo - begin[doc]
            b = base[doc] + hi - begin[doc]
            raw = memoryview(values.tobytes())
            crc = [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(a.tolist(), b.tolist())]
            out = [batch.column(0).take(pa.array(doc)), pa.array(lo - begin[doc]), pa.array(hi - lo),
                   pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(seq), pa.array(lo - seq * window)]
            if with_ids:
                cuts = np.append(a, b[-1] if len(b) else 0).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(values.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][:len(out)])

    kind = placed.schema[key].dataType.simpleString()
    return (placed.select(placed[key].alias("key"), "n_tokens", "ids", "begin")
            .mapInArrow(run, f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                             "sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else ""))
            .withColumnRenamed("key", key))


def sequences(placed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The windows themselves: sequence_id, ids array<int>, doc_starts
    array<int> (offsets at which a document begins), n_ids before padding.

    Every task puts together the windows that lie inside its rows; what is left
    at its edges are boundary records, which meet by sequence id. Only the last
    window can be short: it is padded unless its size is a power of two.
    """

    @lean
    def run(batches):
        held: dict = {"seq": None}

        def flush():
            if held["seq"] is None:
                return None
            row = (held["seq"], held["at"], held["ids"], held["starts"])
            held["seq"] = None
            return row

        for batch in batches:
            out = []
            for n, ids, begin in zip(*(batch.column(i).to_pylist() for i in range(3))):
                done = 0
                while done < n:
                    seq, at = divmod(begin + done, window)
                    take = min(window - at, n - done)
                    if held["seq"] != seq or held["at"] + len(held["ids"]) != at:
                        out.append(flush())
                        held.update(seq=seq, at=at, ids=[], starts=[])
                    held["ids"] += ids[done:done + take]
                    if not done:
                        held["starts"].append(at)
                    done += take
                    if held["at"] + len(held["ids"]) == window:
                        out.append(flush())
            yield _fragments([r for r in out if r])
        last = flush()
        if last:
            yield _fragments([last])

    cut = written(placed.select("n_tokens", "ids", "begin").mapInArrow(
        run, "sequence_id bigint, at int, ids array<int>, doc_starts array<int>"), "windows")
    whole = F.size("ids") == window
    inside = cut.where(whole).select("sequence_id", "ids", "doc_starts")
    borders = (cut.where(~whole).groupBy("sequence_id")                  # at most one record per task edge and window
               .agg(F.sort_array(F.collect_list(F.struct("at", "ids", "doc_starts"))).alias("r"))
               .select("sequence_id", F.flatten("r.ids").alias("ids"), F.flatten("r.doc_starts").alias("doc_starts")))
    n = F.size("ids")
    pad = F.when(F.expr("bit_count(n_ids)") == 1, 0).otherwise(F.lit(window) - F.col("n_ids"))
    return (inside.unionByName(borders).withColumn("n_ids", n)
            .withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), pad.cast("int")))))


def _fragments(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), (), ()]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                      names=["sequence_id", "at", "ids", "doc_starts"])
