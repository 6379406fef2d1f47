import math
import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from numweave.config import curve_sizes
from numweave.operators import generate as G
from numweave.operators import order as O
from numweave.operators import split as P
from numweave.operators import unrank as U
from numweave.functions.numeric import hash_order


def _src(spark, n):
    return spark.range(n).withColumnRenamed("id", "k")


def test_pairs_unique_correct_in_range(spark):
    for fn, op in ((G.gen_pairs_add, lambda a, b: a + b), (G.gen_pairs_sub, lambda a, b: b - a),
                   (G.gen_pairs_mul, lambda a, b: a * b)):
        out = fn(_src(spark, 3000), ["k"], 50, 500, seed=3).collect()
        assert len(out) == 500
        assert len({r.question for r in out}) == 500
        for r in out:
            a, b = sorted(int(x) for x in r.question[:-1].replace("+", " ").replace("-", " ").replace("*", " ").split())
            assert 0 <= a <= b <= 50 and r.label == op(a, b)
            if fn is G.gen_pairs_sub:
                assert r.question == f"{b}-{a}="


def test_decimal_questions_use_python_float_text(spark):
    out = G.gen_pairs_add_decimal(_src(spark, 500), ["k"], 100000, 200, seed=1).collect()
    for r in out:
        a, b = r.question[:-1].split("+")
        assert str(float(a)) == a and str(float(b)) == b
        assert abs(float(a) + float(b) - r.label) < 1e-9


def test_generation_is_partitioning_independent(spark):
    a = G.gen_pairs_add(_src(spark, 2000).repartition(1), ["k"], 1000, 300, seed=2).collect()
    b = G.gen_pairs_add(_src(spark, 2000).repartition(7), ["k"], 1000, 300, seed=2).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_stratified_quota_and_shortfall(spark):
    # max 10: products 0..100, 10 buckets of width 10; the top bucket holds few pairs
    picked = G.gen_pairs_mul_stratified(_src(spark, 20000), ["k"], 10, 100, splits=10, seed=4)
    got = Counter(r.bucket for r in picked.collect())
    assert all(r.shortfall == 10 - got[r.bucket] for r in picked.collect())
    all_pairs = [(a, b) for a in range(11) for b in range(a, 11)]
    avail = Counter(min((a * b) // ((100 + 1) // 10), 9) for a, b in all_pairs)
    for bkt in range(10):
        assert got[bkt] == min(10, avail[bkt])
    rows = picked.collect()
    assert len({r.question for r in rows}) == len(rows)


def test_balanced_threshold_is_median(spark):
    src = _src(spark, 2001)
    scores = G.gen_score_distribution(src, ["k"], 1000, seed=9)
    vals = sorted(r.score for r in scores.collect())
    d = spark.range(1).select(G.median_threshold(scores)).first()[0]
    assert d == vals[len(vals) // 2]


def test_global_index_matches_row_number(spark):
    df = spark.range(5000).withColumn("h", hash_order(1, "id"))
    idx = {r.id: r.idx for r in O.global_index(df, ["h", "id"], bits=6).collect()}
    ref = [r.id for r in df.orderBy("h", "id").collect()]
    assert all(idx[k] == i for i, k in enumerate(ref))


def test_grouped_index_with_hot_group(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
    df = df.withColumn("h", hash_order(2, "id"))
    out = O.global_index(df, ["h", "id"], group_cols=["g"], bits=4).collect()
    by = {}
    for r in out:
        by.setdefault(r.g, []).append((r.h, r.id, r.idx))
    for g, items in by.items():
        assert [x[2] for x in sorted(items)] == list(range(len(items)))


def test_smallest_by_hash_exact_with_skew(spark):
    df = spark.range(6000).withColumn("g", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 7))
    df = df.withColumn("h", hash_order(3, "id"))
    out = O.smallest_by_hash(df, "h", 37, tie_cols=["id"], group_cols=["g"], bits=8).collect()
    local = df.collect()
    for g in {r.g for r in local}:
        want = sorted((r.h, r.id) for r in local if r.g == g)[:37]
        got = sorted((r.h, r.id) for r in out if r.g == g)
        assert got == want
    glob = O.smallest_by_hash(df, "h", 100, tie_cols=["id"]).collect()
    assert sorted((r.h, r.id) for r in glob) == sorted((r.h, r.id) for r in local)[:100]


def test_top_k_per_group(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("o", (F.col("id") * 7919) % 1000)
    out = O.top_k_per_group(df, ["g"], ["o"], 5, salt=8, rank_col="rank").collect()
    for g in range(3):
        want = sorted(r.o for r in df.collect() if r.g == g)[:5]
        assert sorted(r.o for r in out if r.g == g) == want


def test_positional_split_sizes(spark):
    for n in (1000, 33, 7):
        idx = P.index_by_hash(spark.range(n).withColumnRenamed("id", "k"), ["k"], seed=1)
        c = Counter(r.split for r in P.split_positional(idx).collect())
        t = int(n * 0.8 * 0.9)
        v = int(n * 0.8 * 0.1)
        assert c["train"] == t and c.get("validation", 0) == v and c.get("test", 0) == n - t - v


def test_random_split_seeded(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r.k: r.split for r in P.split_random(df, ["k"]).collect()}
    b = {r.k: r.split for r in P.split_random(df.repartition(5), ["k"]).collect()}
    assert a == b
    share = sum(v == "test" for v in a.values()) / len(a)
    assert 0.08 < share < 0.12


def test_nested_prefixes(spark):
    idx = P.index_by_hash(spark.range(1000).withColumnRenamed("id", "k").withColumn("v", F.lit(1.0)), ["k"])
    out = [(r.size, r.n_rows) for r in P.nested_prefixes(idx, "v").orderBy("size").collect()]
    assert [s for s, _ in out] == curve_sizes(1000)
    assert all(n == min(s, 1000) for s, n in out)


def test_curve_sizes_reference_counts():
    assert len(curve_sizes(720000)) == 15
    assert len(curve_sizes(72000)) == 12


def test_head_n(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    order = {r.k: r.idx for r in P.index_by_hash(df, ["k"]).collect()}
    got = {r.k: r.idx for r in P.head_n(df, ["k"], 10).collect()}
    assert got == {k: i for k, i in order.items() if i < 10}
    with pytest.raises(IndexError):
        P.head_n(df, ["k"], 101)


def test_global_rank_matches_sort(spark):
    df = spark.range(3000).select((F.col("id") % 17).alias("f"), F.col("id").cast("string").alias("t"))
    out = {r.t: r.rank for r in O.global_rank(df.repartition(5), [F.desc("f"), F.asc("t")], out="rank", start=2).collect()}
    ref = [r.t for r in df.orderBy(F.desc("f"), F.asc("t")).collect()]
    assert [out[t] for t in ref] == list(range(2, 3002))


def test_global_rank_with_carried_columns(spark):
    """Ids are exactly 2 .. n + 1 whatever the partitions and without reused exchanges."""
    n = 400_000
    for reuse, parts in (("true", 8), ("false", 64)):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            df = spark.range(0, n, 1, parts).select((F.col("id") % 1013).alias("f"), F.md5(F.col("id").cast("string")).alias("t"),
                                                    F.rand(1).alias("extra"))
            out = O.global_rank(df, [F.desc("f"), F.asc("t")], out="rank", start=2)
            r = out.agg(F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()
            assert tuple(r) == (n, n, 2, n + 1)
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")


def test_generators_deliver_n(spark):
    src = _src(spark, 50)                                           # far fewer rows than questions
    assert G.gen_pairs_add(src, ["k"], 10_000, 700, seed=1).distinct().count() == 700
    assert G.gen_triples_label(src, ["k"], 1000, 300, seed=1).distinct().count() == 300
    rows = G.gen_pairs_mul(src, ["k"], 10, 60, seed=1).collect()   # 60 of the 66 pairs
    assert len(rows) == 60 and len({r.question for r in rows}) == 60
    assert G.gen_pairs_mul(src, ["k"], 10, 1000).count() == 66      # fewer pairs than asked: all of them


def test_dense_requests_deliver_every_tuple(spark):
    """n = capacity: every tuple once, whatever the seed."""
    src = _src(spark, 40)
    want = {(a, b, c) for a in range(12) for b in range(a, 12) for c in range(b, 12)}
    for seed in range(12):
        rows = [tuple(map(int, r.question.split(","))) for r in G.gen_triples_label(src, ["k"], 11, 10_000, seed=seed).collect()]
        assert len(rows) == len(want) == 364 and set(rows) == want
    pairs = G.gen_pairs_add(src, ["k"], 30, 496, seed=5).collect()
    assert {r.question for r in pairs} == {f"{a}+{b}=" for a in range(31) for b in range(a, 31)}
    assert G.gen_pairs_add(src.limit(0), ["k"], 30, 10).count() == 0


def test_bijection_for_many_sizes_and_seeds(spark):
    """permuted is a bijection of 0 .. n - 1: 100 seeds, and sizes from 1 up."""
    sizes = spark.range(1, 41).select(F.col("id").alias("n")).unionByName(spark.createDataFrame([(n,) for n in (97, 364, 1000, 4099)], "n bigint"))
    x = sizes.select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("x"))
    bad = (x.select("n", U.permuted(F.col("x"), F.col("n"), 3).alias("y")).groupBy("n")
           .agg(F.count_distinct("y").alias("d"), F.min("y").alias("lo"), F.max("y").alias("hi")).where("d <> n or lo <> 0 or hi <> n - 1"))
    assert bad.count() == 0
    seeds = spark.range(100).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(363).cast("bigint"))).alias("x"))
    got = seeds.select("s", U.permuted(F.col("x"), F.lit(364).cast("bigint"), "seed", F.col("s")).alias("y")).groupBy("s").agg(F.count_distinct("y").alias("d"))
    assert got.where("d = 364").count() == 100
    orders = seeds.where("x < 5").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("x", U.permuted(F.col("x"), F.lit(364).cast("bigint"), "seed", F.col("s"))))).alias("o"))
    assert orders.select("o").distinct().count() > 90


def test_unranking_ends_of_the_range(spark):
    top = 2_000_000
    cases = [0, 1, 2, 3, 5, 6, 10**6, 2**53 - 1, 2**53 + 1, 10**17, U.capacity_of(3, top) - 1]
    df = spark.createDataFrame([(t,) for t in cases], "t bigint")
    for r in df.select("t", U.sorted_triple(F.col("t")).alias("u"), U.sorted_pair(F.col("t")).alias("p")).collect():
        x0, x1, x2 = r.u
        assert 0 <= x0 <= x1 <= x2 <= top
        assert x2 * (x2 + 1) * (x2 + 2) // 6 + x1 * (x1 + 1) // 2 + x0 == r.t
        assert 0 <= r.p.lo <= r.p.hi and r.p.hi * (r.p.hi + 1) // 2 + r.p.lo == r.t
    with pytest.raises(ValueError):
        U.capacity_of(3, 10**8)


def test_stratified_buckets_are_full(spark):
    """Quota met in every bucket that has the pairs, however thin it is."""
    top, n, splits = 999, 5000, 50
    rows = G.gen_pairs_mul_stratified(_src(spark, 700), ["k"], top, n, splits, seed=2).collect()
    width = (top * top + 1) // splits
    have = Counter(min(a * b // width, splits - 1) for a in range(top + 1) for b in range(a, top + 1))
    got = Counter(r.bucket for r in rows)
    assert got == {j: min(n // splits, have[j]) for j in range(splits)}
    assert len({r.question for r in rows}) == len(rows)
    for r in rows:
        a, b = map(int, r.question[:-1].split("*"))
        assert 0 <= a <= b <= top and r.label == a * b and r.bucket == min(a * b // width, splits - 1) and r.shortfall == max(0, n // splits - have[r.bucket])


def test_stratified_at_a_large_range(spark):
    """The thin top buckets of a large range are full, too."""
    rows = G.gen_pairs_mul_stratified(_src(spark, 3000), ["k"], 99_999, 10_000, 100, seed=3)
    got = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("question").alias("d"), F.max("shortfall").alias("s")).collect()
    assert len(got) == 100 and all(r.n == r.d == 100 and r.s == 0 for r in got)


def test_order_key_orders_doubles(spark):
    rng = random.Random(1)
    values = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    values += [0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 1.0, 2.0, 0.5]
    values += [2.0 ** e for e in range(-1074, 1024)] + [math.nextafter(2.0 ** e, 0) for e in range(-1022, 1024)] + [-(2.0 ** e) for e in range(-30, 30)]
    values = [v for v in values if v == v]
    keys = spark.createDataFrame([(v,) for v in values], "v double").select("v", G.order_key(F.col("v")).alias("k")).collect()
    keys.sort(key=lambda r: r.v)
    assert all((x.v == y.v and x.k == y.k) or (x.v < y.v and x.k < y.k) for x, y in zip(keys, keys[1:]))


def test_median_of_outliers_and_heavy_values(spark):
    outlier = spark.range(20001).select(F.when(F.col("id") == 7, 1e300).otherwise(F.col("id") / 1e6).alias("score"))
    assert G.exact_median(outlier).first()[0] == 10001 / 1e6
    heavy = spark.range(30000).select(F.when(F.col("id") % 3 > 0, 0.25).otherwise(F.col("id").cast("double")).alias("score"))
    assert G.exact_median(heavy).first()[0] == 0.25
    assert G.exact_median(heavy.where("false")).first()[0] is None
    assert G.exact_median(spark.createDataFrame([(-0.0,), (0.0,), (float("-inf"),), (3.0,)], "score double")).first()[0] == 0.0


def test_exact_median(spark):
    for values in ([5.0], [1.0, 2.0], [3.0, 3.0, 3.0, 9.0], [float(i * i) for i in range(101)], [-1e9, 0.25, 0.5, 1e9], [2.0, None, 7.0]):
        d = G.exact_median(spark.createDataFrame([(v,) for v in values], "score double")).first()[0]
        real = sorted(v for v in values if v is not None)
        assert d == (real[(len(real) - 1) // 2] + real[len(real) // 2]) / 2
