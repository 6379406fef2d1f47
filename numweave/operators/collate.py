"""Collation (inventory 2.6): batches, padding, masks, number scatter.

A batch is ``idx div B`` over a hash-ordered global index, so batch
membership is deterministic and every batch has at most B rows. The batch
maximum length is a window over ``batch_id`` (bounded partitions of B rows);
everything else is per-row array arithmetic on at most ``max_length``
positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BATCH_SIZE, IGNORE_INDEX, MAX_LENGTH
from ..functions.numeric import hash_order
from .gather import gather


def collate_batch_id(indexed: DataFrame, idx: str = "idx", batch_size: int = BATCH_SIZE,
                     out: str = "batch_id") -> DataFrame:
    return indexed.withColumn(out, F.call_function("div", F.col(idx), F.lit(batch_size)))


def epoch_batches(df: DataFrame, key_cols, seed, epoch: int, batch_size: int = BATCH_SIZE) -> DataFrame:
    """idx and batch_id of a training epoch: rows in the hash order of (seed,
    epoch, key), another one each epoch; evaluation keeps the order of
    ``index_by_hash``."""
    from .order import global_index

    keys = list(key_cols)
    h = df.withColumn("_h", hash_order(f"{seed}:{epoch}", *keys))
    return collate_batch_id(global_index(h, ["_h"] + keys).drop("_h"), batch_size=batch_size)


def collate_pad(df: DataFrame, ids_col: str, pad_id: int, batch_col: str = "batch_id", max_length: int = MAX_LENGTH,
                out: str = "input_ids", length_col: str | None = None) -> DataFrame:
    """Right-pad to the batch maximum, then cut at ``max_length``.
    ``length_col`` holds the full token count when ``ids_col`` was already
    cut at ``max_length`` (the result is the same)."""
    length = F.col(length_col) if length_col else F.size(ids_col)
    bmax = F.max(length).over(Window.partitionBy(batch_col))
    padded = F.concat(F.col(ids_col), F.array_repeat(F.lit(pad_id), (bmax - length).cast("int")))
    return df.withColumn(out, F.slice(padded, 1, max_length))


def attention_mask(ids, pad_id: int) -> Column:
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(ids, lambda t: F.when(t != F.lit(pad_id), 1).otherwise(0))


def collate_attention_mask(df: DataFrame, ids_col: str, pad_id: int, out: str = "attention_mask") -> DataFrame:
    return df.withColumn(out, attention_mask(ids_col, pad_id))


def scatter(ids: str, numbers: str, num_id: int) -> Column:
    """k-th [NUM] position gets the k-th number; surplus [NUM] get 0, surplus
    numbers are dropped. Linear: the [NUM] positions are collected once and
    paired with the numbers in a position -> number map."""
    from ..functions.sqlexpr import let, q

    i_, n_ = q(ids), q(numbers)

    def with_pos(pos):
        k = f"least(size({pos}), size({n_}))"
        m = f"map_from_arrays(slice({pos}, 1, {k}), slice(cast({n_} as array<double>), 1, {k}))"
        return let(m, lambda mp: f"transform({i_}, (t, i) -> CASE WHEN t = {num_id} "
                                 f"THEN coalesce(try_element_at({mp}, i), 0D) ELSE 0D END)")

    positions = f"filter(transform({i_}, (t, i) -> CASE WHEN t = {num_id} THEN i ELSE -1 END), x -> x >= 0)"
    return F.expr(let(positions, with_pos))


def collate_scatter(df: DataFrame, ids_col: str, numbers_col: str, num_id: int, out: str = "scatter") -> DataFrame:
    return df.withColumn(out, scatter(ids_col, numbers_col, num_id))


def collate_last_token(df: DataFrame, ids_col: str, pad_id: int, out: str = "last_pos") -> DataFrame:
    """Index of the last non-PAD token (PAD only ever sits on the right)."""
    return df.withColumn(out, F.size(F.filter(ids_col, lambda t: t != F.lit(pad_id))) - 1)


def collate_loss_labels(df: DataFrame, ids_col: str, qlen_col: str, pad_id: int, out: str = "labels") -> DataFrame:
    """Token id where position >= question length and not PAD, else -100."""
    q = F.col(qlen_col)
    return df.withColumn(out, F.transform(
        ids_col, lambda t, i: F.when((i >= q) & (t != F.lit(pad_id)), t).otherwise(F.lit(IGNORE_INDEX))))


def pool_last_token(df: DataFrame, vectors_col: str, last_col: str, out: str = "pooled") -> DataFrame:
    """Vector of the last non-PAD position from a per-position vector array."""
    return df.withColumn(out, F.get(F.col(vectors_col), F.col(last_col)))


def pool_last_token_long(states: DataFrame, key_cols, pos_col: str, last: DataFrame, vectors: DataFrame,
                         id_col: str, vector_col: str) -> DataFrame:
    """Table form: (key, pos, vector id) against (key, last_pos). The position is
    picked before any vector moves; a key without a last token keeps a NULL vector."""
    keys = list(key_cols)
    picked = last.join(states, [last[k] == states[k] for k in keys] + [states[pos_col] == last["last_pos"]], "left") \
        .select(*[last[k] for k in keys], "last_pos", id_col)
    return gather(picked, id_col, vectors, vector_col, keys).select(*keys, "last_pos", vector_col)
