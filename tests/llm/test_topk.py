import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numweave.llm import topk
from numweave.llm.queries import QUERIES

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                    T.StructField("score", T.StringType()), T.StructField("block", T.StringType())])


def brute(rows, every, k=5):
    ok = []
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for at, (q, qv) in enumerate(ok):
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(qv, cv)), c) for j, (c, cv) in enumerate(ok) if j != at)[:k]
            out += [(q, r, c, -x) for r, (x, c) in enumerate(s, 1)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("block_vectors,block_queries", [(4096, 512), (32, 7)])
def test_equals_brute_force(spark, block_vectors, block_queries):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(12, 12)) * np.geomspace(3, 0.01, 12)
    rows = [(i, [float(x) for x in rng.normal(size=12) @ mix * rng.exponential()], "s", "b") for i in range(300)]
    rows += [(1000 + i, [0.5] * 12, "", "") for i in range(60)]                  # many ties
    rows += [(2000, None, "", ""), (2001, [1.0, None], "", ""), (2002, [math.nan] * 12, "", ""), (2003, [math.inf], "", ""),
             (2010, [], "", ""), (2020, [0.3, 0.2], "", ""), (None, [9.0] * 12, "", ""), (10, [7.0] * 12, "", ""),
             (10, [7.0] * 12, "", ""), (-30, [0.0] * 12, "", "")]
    df = spark.createDataFrame(rows, VEC).repartition(3)
    out = topk.search(df, F.pmod("id", F.lit(10)) == 0, 5, block_vectors=block_vectors, block_queries=block_queries)
    assert got(out) == brute(rows, 10)


def test_fewer_rows_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0], "", ""), (50, [0.5, 0.25], "", ""), (3, [-1.0, 0.0], "", "")]
    df = spark.createDataFrame(rows, VEC)
    assert got(topk.search(df, F.pmod("id", F.lit(50)) == 0)) == brute(rows, 50)
    assert topk.search(df.where("false"), F.pmod("id", F.lit(50)) == 0).count() == 0
    same = [(50, [1.0], "", ""), (1, [0.5], "", ""), (1, [0.5], "", ""), (2, [0.25], "", ""), (50, [2.0], "", "")]
    assert got(topk.search(spark.createDataFrame(same, VEC), F.pmod(F.col("id"), F.lit(50)) == 0)) == brute(same, 50)    # repeated ids
    none = [(0, [], "", ""), (1, [], "", ""), (2, [], "", "")]
    assert got(topk.search(spark.createDataFrame(none, VEC), F.pmod(F.col("id"), F.lit(50)) == 0)) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    one = df.where("vec_id = 0")
    assert topk.search(one, F.pmod("id", F.lit(50)) == 0).count() == 0


def test_pruning_skips_pairs_without_changing_results(monkeypatch):
    rng = np.random.default_rng(5)
    c = np.floor(rng.normal(size=(3000, 16)) * np.geomspace(200, 1, 16))
    c = c[np.argsort(-(c ** 2).sum(1))]
    q = c[rng.choice(3000, 20)]
    ids = np.arange(3000)
    turn, head = topk.rotation(c.T @ c)
    assert head < 16
    who, cid, row, s = topk.best_of(-np.arange(1, 21), q, np.full(20, -np.inf), ids, ids, c, turn, head, 5)
    assert (row == cid).all()
    full = q @ c.T
    for i in range(20):
        want = np.lexsort((ids, -full[i]))[:5]
        assert cid[who == i].tolist() == want.tolist() and s[who == i].tolist() == full[i][want].tolist()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(QUERIES["op6_topk_inner"](spark, sf)) == brute(rows, 50)
