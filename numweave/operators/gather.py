"""Vectors fetched by id, even where few ids hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARES = 1000              # an id with more than 1 / SHARES of all rows is heavy: there are fewer than SHARES of them
FREQUENT_IDS = 65_536      # at most so many ids are resolved where their rows are,
FREQUENT_BYTES = 16 << 20  # with vectors of about so many bytes


def gather(rows: DataFrame, id_col: str, vectors: DataFrame, vec_col: str, spread_by) -> DataFrame:
    """rows and the vector of their id (NULL without one); ``vectors``: id_col,
    vec_col, one row per id.

    Ids are counted. The vectors of the frequent ones, as many as a broadcast
    of bounded size holds, go to where the rows are; also that a frequent id
    has no vector is known there. Rows without an id stay as well. Only rows
    of the other ids are shuffled. If some of those are heavy (wide vectors),
    their vectors are replicated in proportion to their rows and the rows are
    dealt over the copies by a hash of ``spread_by``, so that no task gets more
    than about 1 / SHARES of all rows for one id. ``rows`` is read three times:
    pass a pinned table if it is costly.
    """
    vectors = vectors.select(id_col, vec_col)
    counts = rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    total = counts.agg(F.sum("_n")).scalar()
    width = vectors.agg(F.max(F.size(vec_col))).first()[0] or 1
    shares = max(1, min(FREQUENT_IDS, FREQUENT_BYTES // (8 * width + 32)))
    known = F.col("_n") * F.lit(shares) > total                                              # fewer than ``shares`` rows
    frequent = counts.filter(known).select(id_col, F.lit(True).alias("_here")).join(vectors, id_col, "left")
    near = rows.join(F.broadcast(frequent), id_col, "left").filter(F.col("_here") | F.col(id_col).isNull()).drop("_here")
    far = rows.join(F.broadcast(counts.filter(known).select(id_col)), id_col, "left_anti").filter(F.col(id_col).isNotNull())
    if shares >= SHARES:                                                                     # none of the others is heavy
        return near.unionByName(far.join(vectors, id_col, "left"))
    copies = F.ceil(F.col("_n") * F.lit(float(SHARES)) / total).cast("int")
    heavy = F.broadcast(counts.filter(~known & (F.col("_n") * F.lit(SHARES) > total)).select(id_col, copies.alias("_copies")))
    dealt = F.pmod(F.xxhash64(*spread_by), F.coalesce("_copies", F.lit(1))).cast("int")
    left = far.join(heavy, id_col, "left").withColumn("_copy", dealt).drop("_copies")
    right = (vectors.join(heavy, id_col, "left")
             .select(id_col, vec_col, F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)).alias("_copy")))
    return near.unionByName(left.join(right, [id_col, "_copy"], "left").drop("_copy"))
