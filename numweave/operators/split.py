"""Splits and sampling (inventory 2.3).

Positional operations of the reference (first n rows, 72/8/20 slices,
learning-curve prefixes) need a global order; it is the hash order of a key
(``order.global_index``), numbered without a single-task window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (CURVE_SIZE_START, RANDOM_SPLIT_SEED, RANDOM_TEST_SIZE, SPLIT_RATIO,
                      TRAIN_SHARE_OF_SPLIT, VALIDATION_SHARE_OF_SPLIT)
from ..functions.numeric import hash_order, hash_uniform
from .order import global_index, smallest_by_hash


def index_by_hash(df: DataFrame, key_cols, seed=0, out: str = "idx") -> DataFrame:
    """Global 0-based index in hash order of the (unique) key."""
    keys = list(key_cols)
    h = df.withColumn("_h", hash_order(seed, *keys))
    return global_index(h, ["_h"] + keys, out=out).drop("_h")


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def split_positional(indexed: DataFrame, idx: str = "idx", out: str = "split", base: DataFrame | None = None) -> DataFrame:
    """train = first int(n*0.8*0.9), validation = next int(n*0.8*0.1), test = rest.
    ``base``: the table before it was indexed, cheaper to count."""
    n = _count(indexed if base is None else base).cast("double")
    cut1 = (n * F.lit(SPLIT_RATIO) * F.lit(TRAIN_SHARE_OF_SPLIT)).cast("bigint")
    cut2 = cut1 + (n * F.lit(SPLIT_RATIO) * F.lit(VALIDATION_SHARE_OF_SPLIT)).cast("bigint")
    return indexed.withColumn(
        out, F.when(F.col(idx) < cut1, "train").when(F.col(idx) < cut2, "validation").otherwise("test"))


def split_random(df: DataFrame, key_cols, test_size: float = RANDOM_TEST_SIZE, seed=RANDOM_SPLIT_SEED,
                 out: str = "split") -> DataFrame:
    """Seeded split by a stable hash fraction of the key (partitioning-independent)."""
    u = hash_uniform(seed, *key_cols)
    return df.withColumn(out, F.when(u < F.lit(float(test_size)), "test").otherwise("train"))


def head_n(df: DataFrame, key_cols, n: int | None, seed=0, out: str = "idx") -> DataFrame:
    """The first n rows in the hash order of the key, numbered; ``None`` keeps
    all. Only the picked rows are ranked. Asking for more rows than there are
    raises IndexError (one count)."""
    keys = list(key_cols)
    if n is None:
        return index_by_hash(df, keys, seed=seed, out=out)
    total = df.count()
    if n > total:
        raise IndexError(f"head_n({n}) beyond {total} rows")
    h = df.withColumn("_h", hash_order(seed, *keys))
    picked = smallest_by_hash(h, "_h", int(n), tie_cols=keys)
    return global_index(picked, ["_h", *keys], out=out).drop("_h")


def prefix_size_of(idx: Column, n: Column, max_sizes: int = 48) -> Column:
    """Smallest curve size (100, 200, 400, ..., n) containing position idx."""
    expr = None
    s = CURVE_SIZE_START
    for _ in range(max_sizes):
        cond = idx < F.lit(s)
        expr = F.when(cond, F.lit(s)) if expr is None else expr.when(cond, F.lit(s))
        s *= 2
    return F.least(expr.otherwise(n), n)


def nested_prefixes(indexed: DataFrame, value_col: str, idx: str = "idx", base: DataFrame | None = None) -> DataFrame:
    """Aggregates of every learning-curve prefix (sizes 0, 100*2^k < n, n).

    Rows are not fanned out per size: each row is counted once under the
    smallest size containing it, then a running sum over the (<= 48) sizes
    gives each nested prefix.
    """
    spark = indexed.sparkSession
    n = _count(indexed if base is None else base)
    per = (indexed.groupBy(prefix_size_of(F.col(idx), n).alias("size"))
           .agg(F.count(F.lit(1)).alias("_n"), F.sum(value_col).alias("_s")))
    zero = spark.range(1).select(F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("_n"),
                                 F.lit(None).cast("double").alias("_s"))
    allsizes = per.select(F.col("size").cast("bigint").alias("size"), "_n", F.col("_s").cast("double")).unionByName(zero)
    win = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return allsizes.select("size", F.sum("_n").over(win).alias("n_rows"), F.sum("_s").over(win).alias("value_sum"))
