"""Connected components of a graph of any size by alternating stars.

Every node repeatedly points its larger neighbours (large star), then its
smaller ones (small star), at the smallest node it knows. Only minima per node
are aggregated and edges are never gathered per node, so a hub with very many
neighbours is split like any other skewed key. The number of rounds grows with
the logarithm of the longest path; each round is a committed table. The steps
are the same for every size; a graph of few edges stays in one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

MAX_ROUNDS = 60
SMALL_EDGES = 200_000          # a graph of at most this many edges needs no shuffle: one task holds it


def _edges(pairs: DataFrame) -> DataFrame:
    """u > v, each once."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) for every node that has
    a link to another one."""
    edges = written(_edges(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "components")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        def together(df, small=state[0] <= SMALL_EDGES):
            return df.coalesce(1) if small else df

        both = together(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        stars = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                               F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(_edges(together(stars)), "components")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(roots.select("node", F.col("node").alias("root"))))
