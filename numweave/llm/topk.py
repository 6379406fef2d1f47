"""Exact top-k by inner product over norm-sorted vectors.

Vectors become integers floor(scale * x). They are sorted by descending length
and packed into blocks; queries are packed into blocks of their own. An
orthogonal rotation (the singular vectors of all rows) moves most of the
length into the first coordinates, so a partial sum over those plus the
Cauchy-Schwarz bound on the rest says which pairs can still reach a query's
k-th best score; only those get the exact integer product. The first block,
which has the longest vectors, gives every query a floor to start from, and
blocks too short to reach the floor of a query block are not paired with it.

Defined cases: vectors that are null or hold null or non-finite components
take no part, nor do rows without an id; rows are known by a number of their
own, so rows with the same id are queries and candidates each; shorter vectors
count as padded with zeros (all empty: score 0); equal scores go to the smaller
id; an empty table gives no rows. Only id and vector are read. Integer products must fit in 53 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

BLOCK_VECTORS, BLOCK_QUERIES = 4096, 512
STEP = 512                     # vectors looked at before a query's floor rises again
HEAD_SHARE = 0.8               # of the summed squares that the leading coordinates must hold


def integers(table: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """id, v array<bigint>, n2 (squared length), row (a number) of the rows that take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    ints = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return (table.where(table[key].isNotNull() & table[vector].isNotNull()).where(fine)
            .select(table[key].alias("id"), ints.alias("v"))
            .withColumn("n2", F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x * x))
            .withColumn("row", F.monotonically_increasing_id()))


def second_moments(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Sum of v v' over all rows and the width (0 without rows): width^2 numbers reach the driver."""
    width = rows.agg(F.max(F.greatest(F.size("v"), F.lit(1)))).first()[0] or 0

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = dense(batch.column(0), width).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["cell", "s"])

    got = rows.select("v").mapInArrow(run, "cell bigint, s double").groupBy("cell").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(width * width)
    out[got["cell"].to_numpy()] = got["s"].to_numpy()
    return out.reshape(width, width), width


def rotation(moments: np.ndarray) -> tuple[np.ndarray, int]:
    """Columns by descending share of the summed squares, and how many of them
    make up the head."""
    if not len(moments):
        return moments, 0
    value, vector = np.linalg.eigh(moments)
    value, vector = np.maximum(value[::-1], 0), np.ascontiguousarray(vector[:, ::-1])
    share = np.cumsum(value) / max(value.sum(), 1e-300)
    return vector, int(np.searchsorted(share, HEAD_SHARE) + 1)


def dense(column: pa.Array, width: int) -> np.ndarray:
    """List column as a matrix, shorter rows padded with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def packed(rows: DataFrame, width: int, block: int, name: str) -> DataFrame:
    """Blocks of rows in descending length: block (number, in that order), ids,
    rows, v (binary int64 vectors and matrices), longest (length of the longest)."""
    order = [F.col("n2").desc(), F.col("id").asc(), F.col("row").asc()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "v", "n2", "row")

    def run(batches):
        ids, mats, n2, own, held = [], [], [], [], 0

        def take():
            nonlocal ids, mats, n2, own, held
            i, m, n, r = (np.concatenate(x) for x in (ids, mats, n2, own))
            out = i[:block], m[:block], n[:block], r[:block]
            ids, mats, n2, own, held = [i[block:]], [m[block:]], [n[block:]], [r[block:]], max(0, held - block)
            return pa.RecordBatch.from_arrays([
                pa.array([int(out[2][0])]), pa.array([int(out[0][0])]), pa.array([int(out[3][0])]), pa.array([len(out[0])], pa.int32()),
                *(pa.array([x.astype("<i8").tobytes()]) for x in (out[0], out[3], out[1]))],
                names=["n2", "first_id", "first_row", "n", "ids", "rows", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0).cast(pa.int64()).to_numpy())
            mats.append(dense(batch.column(1), width))
            n2.append(batch.column(2).to_numpy())
            own.append(batch.column(3).to_numpy())
            held += batch.num_rows
            while held >= block:
                yield take()
        if held:
            yield take()

    table = written(ordered.mapInArrow(run, "n2 bigint, first_id bigint, first_row bigint, n int, ids binary, rows binary, v binary"), name)
    number = table.select("first_row", (F.row_number().over(                                # one row per block
        Window.orderBy(F.col("n2").desc(), F.col("first_id"), F.col("first_row"))) - 1).alias("block"))
    return (table.join(F.broadcast(number), "first_row")
            .select("block", "ids", "rows", "v", F.sqrt(F.col("n2").cast("double")).alias("longest")))


def best_of(q_rows, q, floors, c_ids, c_rows, c, turn, head, k):
    """(query index, candidate id, candidate row, score) of up to k candidates
    per query that reach its floor: exact, in steps of descending length."""
    rq, rc = q @ turn, c @ turn
    q_tail = np.sqrt((rq[:, head:] ** 2).sum(1))
    c_tail = np.sqrt((rc[:, head:] ** 2).sum(1))
    q_len, c_len = np.sqrt((q ** 2).sum(1)), np.sqrt((c ** 2).sum(1))
    floors = floors.copy()
    who, cid, row, got = (np.zeros(0, np.int64) for _ in range(4))
    for a in range(0, len(c), STEP):
        b = min(a + STEP, len(c))
        slack = 1e-9 * (1 + q_len[:, None] * c_len[None, a:b])
        alive = np.flatnonzero(q_len * c_len[a] * (1 + 1e-9) + 1e-6 >= floors)   # length alone
        if not len(alive):
            continue
        bound = rq[alive, :head] @ rc[a:b, :head].T + q_tail[alive, None] * c_tail[None, a:b] + slack[alive]
        can = (bound >= floors[alive, None]) & (q_rows[alive, None] != c_rows[None, a:b])
        i, j = np.nonzero(can)
        if not len(i):
            continue
        i = alive[i]
        if len(i) * 4 > len(alive) * (b - a):
            s = (q @ c[a:b].T)[i, j]
        else:
            s = np.concatenate([np.einsum("nd,nd->n", q[i[x:x + 65536]], c[a + j[x:x + 65536]])
                                for x in range(0, len(i), 65536)])
        reach = s >= floors[i]
        i, j, s = i[reach], j[reach], s[reach].astype(np.int64)
        who, cid, row, got = (np.concatenate(x) for x in ((who, i), (cid, c_ids[a + j]), (row, c_rows[a + j]), (got, s)))
        order = np.lexsort((row, cid, -got, who))
        who, cid, row, got = who[order], cid[order], row[order], got[order]
        begin = np.flatnonzero(np.diff(who, prepend=-1))
        rank = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))
        keep = rank < k
        full = np.flatnonzero(rank == k - 1)
        floors[who[full]] = np.maximum(floors[who[full]], got[full])
        who, cid, row, got = who[keep], cid[keep], row[keep], got[keep]
    return who, cid, row, got


def _scores(pairs: DataFrame, width: int, turn: np.ndarray, head: int, k: int) -> DataFrame:
    """query_id, query_row, vec_id, row, score from blocks of queries and candidates."""

    def run(batches):
        for batch in batches:
            for qi, qr, qv, fl, ci, cr, cv in zip(*(col.to_pylist() for col in batch.columns)):
                q_ids, q_rows, c_ids, c_rows = (np.frombuffer(x, "<i8") for x in (qi, qr, ci, cr))
                q = np.frombuffer(qv, "<i8").reshape(-1, width).astype(np.float64)
                c = np.frombuffer(cv, "<i8").reshape(-1, width).astype(np.float64)
                floors = np.full(len(q), -np.inf) if fl is None else np.array([-np.inf if x is None else x for x in fl])
                who, cid, row, got = best_of(q_rows, q, floors, c_ids, c_rows, c, turn, head, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[who], q_rows[who], cid, row, got)],
                                                 names=["query_id", "query_row", "vec_id", "row", "score"])

    return (pairs.select("q_ids", "q_rows", "q_v", "floors", "ids", "rows", "v")
            .mapInArrow(run, "query_id bigint, query_row bigint, vec_id bigint, row bigint, score bigint"))


def search(table: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
           scale: float = 256.0, block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row for
    which ``is_query`` (a condition on the column id) holds."""
    spark = table.sparkSession
    rows = written(integers(table, key, vector, scale), "topk-integers")
    moments, width = second_moments(rows)
    if not width:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    turn, head = rotation(moments)
    blocks = packed(rows, width, block_vectors, "topk-blocks")
    queries = (packed(rows.where(is_query), width, block_queries, "topk-queries")
               .select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("v").alias("q_v"),
                       F.col("longest").alias("q_longest")))
    n_blocks = blocks.select("block").agg(F.max("block")).first()[0] + 1
    own = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("row"))
    no_floor = F.lit(None).cast("array<double>")
    # the longest vectors first: one block, paired with every query block by its number
    first = written(_scores(queries.withColumn("block", F.lit(0)).withColumn("floors", no_floor)
                            .join(blocks.where("block = 0"), "block"), width, turn, head, k), "topk-first")
    if n_blocks == 1:
        found = first
    else:
        floor = (first.withColumn("r", F.row_number().over(own)).where(F.col("r") == k)
                 .select("query_row", F.col("score").cast("double").alias("floor")))
        queries = written(_with_floors(queries, floor), "topk-floors")
        # which blocks can matter is settled on numbers alone; vectors move for those pairs only
        pairs = (queries.select("q_block", "q_longest", "lowest", F.explode(F.sequence(F.lit(1), F.lit(n_blocks - 1))).alias("block"))
                 .join(blocks.select("block", F.col("longest").alias("c_longest")), "block")
                 .where((F.col("lowest").isNull()) | (F.col("q_longest") * F.col("c_longest") * (1 + 1e-9) + 1e-6 >= F.col("lowest")))
                 .select("q_block", "block"))
        rest = pairs.join(queries, "q_block").join(blocks, "block")
        found = first.unionByName(_scores(rest, width, turn, head, k))
    return (found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _with_floors(queries: DataFrame, floor: DataFrame) -> DataFrame:
    """Adds floors (per query of the block, null without k scores) and lowest
    (their minimum, null if one is missing)."""

    def run(batches):
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), b, np.int32)), pa.array(np.arange(len(rows))),
                                                  pa.array(rows)], names=["q_block", "at", "query_row"])

    each = queries.select("q_block", "q_rows").mapInArrow(run, "q_block int, at bigint, query_row bigint")
    per_block = (each.join(floor, "query_row", "left").groupBy("q_block")
                 .agg(F.sort_array(F.collect_list(F.struct("at", "floor"))).alias("f"),
                      F.min("floor").alias("low"), F.count("floor").alias("known"), F.count(F.lit(1)).alias("n"))
                 .select("q_block", F.col("f.floor").alias("floors"),
                         F.when(F.col("known") == F.col("n"), F.col("low")).alias("lowest")))
    return queries.join(per_block, "q_block")
