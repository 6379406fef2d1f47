"""Global order without a single-task bottleneck.

* ``global_index``: 0-based position of every row in a total order whose first
  key is a 60-bit hash order (``functions.numeric.hash_order``). Rows are
  bucketed by the hash's top bits (uniform, deterministic — no sampling),
  bucket sizes are counted (a tiny aggregate), their running offsets are
  broadcast (at most 2^bits rows), and each bucket is numbered by its own
  window task. Re-running any task yields the same numbers, so executor loss
  cannot renumber rows.
* ``smallest_by_hash``: exactly the ``n`` rows with the smallest hash per
  group (global when no group). Instead of ``orderBy().limit(n)`` (one task
  merges every partition's top n) or a window over a whole group (one task per
  group; a hot group would hold a third of the rows), a histogram of hash
  prefixes per group finds the threshold prefix; a second pass keeps the rows
  up to it, and only those (about n) are ranked, each window partition being
  one hash prefix of one group (about 1/2^bits of it).
* ``top_k_per_group``: small-k top-k per group by an arbitrary order, salted in
  two stages so no task sees more than ``salt * k`` rows of one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 60


BUCKET_ROWS = 100_000      # rows that one numbering task ranks, about


def _bits_for(df: DataFrame, bits: int | None) -> int:
    """As many buckets as the number of rows asks for, known from the plan's
    size estimate (file sizes): no pass over the rows is spent on it, and the
    numbers do not depend on it."""
    if bits is not None:
        return bits
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - no access to the plan (e.g. a Connect session)
        size = 0
    return min(20, max(12, (size // (16 * BUCKET_ROWS)).bit_length()))


def global_index(df: DataFrame, order_cols, out: str = "idx", bits: int | None = None,
                 group_cols=(), broadcast_offsets: bool | None = None) -> DataFrame:
    """Add ``out`` = 0-based rank in the order ``order_cols`` (first one a hash
    order; the full key must be unique), restarting per ``group_cols``.

    The offsets table has (groups x 2^bits) rows; it is broadcast when there
    is no grouping or the caller vouches for a small group set, otherwise
    the join is left to AQE."""
    order_cols = list(order_cols)
    group_cols = list(group_cols)
    bits = _bits_for(df, bits)
    keyed = df.withColumn("_bkt", F.shiftright(F.col(order_cols[0]), HASH_BITS - bits))
    counts = keyed.groupBy(*group_cols, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    ow = (Window.partitionBy(*group_cols) if group_cols else Window).orderBy("_bkt").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(*group_cols, "_bkt", (F.sum("_n").over(ow) - F.col("_n")).alias("_off"))
    if broadcast_offsets is None:  # bounded by 2^bits only without grouping
        broadcast_offsets = not group_cols
    if broadcast_offsets:
        offsets = F.broadcast(offsets)
    w = Window.partitionBy(*group_cols, "_bkt").orderBy(*order_cols)
    return (
        keyed.join(offsets, group_cols + ["_bkt"])
        .withColumn(out, (F.row_number().over(w) - 1 + F.col("_off")).cast("bigint"))
        .drop("_bkt", "_off")
    )


def smallest_by_hash(df: DataFrame, hash_col: str, n, tie_cols=(), group_cols=(),
                     bits: int = 16, broadcast_thresholds: bool = False) -> DataFrame:
    """Rows with the ``n`` smallest (hash, tie_cols) per group.

    ``n`` is an int or the name of a column holding the per-group quota.
    Groups holding fewer rows than their quota return all of them.
    """
    group_cols = list(group_cols)
    synthetic = not group_cols
    if synthetic:  # one global group: a constant key for the histogram window
        df = df.withColumn("_g", F.lit(0))
        group_cols = ["_g"]
    quota = F.lit(int(n)) if not isinstance(n, str) else F.col(n)
    pre = F.shiftright(F.col(hash_col), HASH_BITS - bits)
    d = df.withColumn("_pre", pre).withColumn("_quota", quota)
    hist = d.groupBy(*group_cols, "_pre").agg(F.count(F.lit(1)).alias("_cnt"), F.first("_quota").alias("_q"))
    w = Window.partitionBy(*group_cols).orderBy("_pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("_cum", F.sum("_cnt").over(w))
    thr = hist.groupBy(*group_cols).agg(
        F.min(F.when(F.col("_cum") >= F.col("_q"), F.col("_pre"))).alias("_pstar"),
        F.min_by(F.col("_q") - (F.col("_cum") - F.col("_cnt")),
                 F.when(F.col("_cum") >= F.col("_q"), F.col("_pre"))).alias("_need"),
    )
    we = Window.partitionBy(*(group_cols + ["_pre"])).orderBy(hash_col, *tie_cols)
    if synthetic:
        # one global threshold: a scalar subquery (one struct), no join at all
        t = thr.select(F.struct("_pstar", "_need").alias("t")).scalar()
        d = d.withColumn("_pstar", t.getField("_pstar")).withColumn("_need", t.getField("_need"))
    else:
        if broadcast_thresholds:  # one row per group of a bounded group set
            thr = F.broadcast(thr)
        d = d.join(thr, group_cols, "left")
    # second and last pass over the input: keep rows up to the threshold prefix;
    # the window sees only kept rows (about the requested n), each partition
    # one hash prefix of one group
    pstar = F.col("_pstar")
    kept = d.filter(pstar.isNull() | (F.col("_pre") <= pstar))
    ranked = kept.withColumn("_rn", F.row_number().over(we))
    out = ranked.filter(pstar.isNull() | (F.col("_pre") < pstar) | (F.col("_rn") <= F.col("_need")))
    return out.drop("_pre", "_quota", "_pstar", "_need", "_rn", *(["_g"] if synthetic else []))


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int, salt: int = 64,
                    rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows per group in ``order_cols`` order (order must be total).

    Stage 1 ranks inside (group, salt) sub-groups, keeping k each; stage 2 ranks
    the at most ``salt * k`` survivors of each group.
    """
    group_cols = list(group_cols)
    order_cols = list(order_cols)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) if isinstance(c, str) else c
                                                        for c in order_cols]), F.lit(salt)))
    w1 = Window.partitionBy(*(group_cols + ["_salt"])).orderBy(*order_cols)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols) if group_cols else Window.orderBy(*order_cols)
    name = rank_col or "_r2"
    out = stage1.withColumn(name, F.row_number().over(w2)).filter(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def global_rank(df: DataFrame, order_exprs, out: str = "rank", start: int = 0) -> DataFrame:
    """Dense 0-based (+ ``start``) position in an arbitrary total order,
    without a single-partition window.

    ``orderBy`` range-partitions the rows (sampled bounds), every partition
    is sorted; the partition id and a per-partition row counter are taken in
    that layout and pinned with a reliable ``checkpoint`` (so a retried task
    cannot renumber), partition sizes give running offsets (at most one row
    per partition, broadcast), and position = offset + row counter.
    The pin is not optional: sampled range bounds may differ between two
    evaluations, and positions and offsets must come from the same one.
    """
    s = (df.orderBy(*order_exprs)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    s = s.checkpoint(eager=True)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select("_pid", (F.sum("_n").over(w) - F.col("_n")).alias("_off"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_off") + local + F.lit(start)).cast("bigint"))
            .drop("_pid", "_mid", "_off"))
