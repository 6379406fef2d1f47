import pytest
from pyspark.sql import functions as F

from numweave.operators import collate as C
from numweave.operators import text as X
from numweave.operators.gather import gather
from numweave.operators.split import index_by_hash

PAD, NUM = 0, 1


def test_batches_pad_and_masks(spark):
    rows = [(i, list(range(2, 2 + (i % 5) + 1))) for i in range(33)]
    df = spark.createDataFrame(rows, "k int, ids array<int>")
    b = C.collate_batch_id(index_by_hash(df, ["k"]), batch_size=32)
    sizes = sorted(r["count"] for r in b.groupBy("batch_id").count().collect())
    assert sizes == [1, 32]                       # partial last batch
    p = C.collate_attention_mask(C.collate_pad(b, "ids", PAD), "input_ids", PAD).collect()
    for r in p:
        bmax = max(len(x.ids) for x in p if x.batch_id == r.batch_id)
        assert len(r.input_ids) == bmax
        assert r.attention_mask == [1] * len(r.ids) + [0] * (bmax - len(r.ids))


def test_cut_at_max_length(spark):
    df = spark.createDataFrame([(0, 0, list(range(2, 300)))], "k int, batch_id int, ids array<int>")
    r = C.collate_pad(df, "ids", PAD).first()
    assert len(r.input_ids) == 128


def test_scatter_surplus_tokens_and_numbers(spark):
    df = spark.createDataFrame([
        ([5, NUM, 6, NUM, NUM, PAD], [1.5, 2.5]),        # more [NUM] than numbers
        ([NUM, 5], [7.0, 8.0, 9.0]),                     # more numbers than [NUM]
        ([5, 6], []),
    ], "ids array<int>, nums array<double>")
    out = [r.s for r in df.select(C.scatter("ids", "nums", NUM).alias("s")).collect()]
    assert out[0] == [0.0, 1.5, 0.0, 2.5, 0.0, 0.0]
    assert out[1] == [7.0, 0.0]
    assert out[2] == [0.0, 0.0]


def test_last_token_and_loss_labels(spark):
    df = spark.createDataFrame([([5, 6, 7, PAD, PAD], 2)], "input_ids array<int>, qlen int")
    r = C.collate_loss_labels(C.collate_last_token(df, "input_ids", PAD), "input_ids", "qlen", PAD).first()
    assert r.last_pos == 2
    assert r.labels == [-100, -100, 7, -100, -100]


def test_pool_last_token(spark):
    df = spark.createDataFrame([([[1.0], [2.0], [3.0]], 1)], "states array<array<double>>, last_pos int")
    assert C.pool_last_token(df, "states", "last_pos").first().pooled == [2.0]
    assert F is not None


def test_ids_with_a_tail_equal_a_plain_lookup(spark, monkeypatch):
    """A vocabulary larger than its head: rare tokens are patched in, unknown ones stay unknown."""
    monkeypatch.setattr(X, "HEAD_VOCAB_IDS", 5)
    docs = [(i, [f"t{(i * j) % 13}" for j in range(i % 7)]) for i in range(60)] + [(None, ["t1", "t12"]), (100, []), (101, None)]
    df = spark.createDataFrame(docs, "k bigint, tokens array<string>")
    vocab = X.vocab_build(df.select(F.explode("tokens").alias("token"))).where("token <> 't3'")
    ids = {r.token: r.id for r in vocab.collect()}
    assert max(ids.values()) > 5 and ids["[PAD]"] == 0 and ids["[NUM]"] == 1
    got = {r.k: r.input_ids for r in X.encode_token_ids(df, ["k"], "tokens", vocab).collect()}
    assert got == {k: [ids.get(t, -1) for t in (tokens or [])] for k, tokens in docs}
    cut = X.encode_token_ids(df.withColumn("c", F.lit(7)), ["k"], "tokens", vocab, max_positions=2, carry=["c"]).collect()
    assert {r.k: (r.input_ids, r.n_tokens, r.c) for r in cut} == {
        k: ([ids.get(t, -1) for t in (tokens or [])[:2]], len(tokens or []), 7) for k, tokens in docs}


def _shuffle_rows(spark, df):
    """Rows per task of the last stage that reads a shuffle, without AQE and automatic broadcasts."""
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_lookup_and_gather_spread_hot_tokens(spark, monkeypatch):
    """Half of all positions hold one token: no task of the joins gets more than twice the median."""
    monkeypatch.setattr(X, "HEAD_VOCAB_IDS", 50)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    docs = spark.range(4000).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda j: F.when(
        j % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.pmod(F.xxhash64("id", j), F.lit(3000))))).alias("tokens"))
    vocab = X.vocab_build(docs.select(F.explode("tokens").alias("token")))
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        ids = X.encode_token_ids(docs, ["k"], "tokens", vocab).checkpoint()
        per_task = _shuffle_rows(spark, ids)
        assert sum(per_task) == 4000 and per_task[-1] <= 2 * per_task[len(per_task) // 2]
        vectors = vocab.select("id", F.array(F.col("id").cast("double")).alias("v"))
        rows = X.lookup_token_vectors(ids, ["k"], "input_ids", vectors, "id", "v")
        per_task = _shuffle_rows(spark, rows)
        assert sum(per_task) == 80000 and per_task[-1] <= 2 * per_task[len(per_task) // 2]
        assert rows.where("v[0] = id").count() == 80000
        last = ids.select("k", F.lit(18).alias("last_pos"))
        states = ids.select("k", F.posexplode("input_ids").alias("pos", "id"))
        pooled = C.pool_last_token_long(states, ["k"], "pos", last, vectors, "id", "v")
        per_task = _shuffle_rows(spark, pooled)
        assert sum(per_task) == 4000 and per_task[-1] <= 2 * per_task[len(per_task) // 2]
    finally:
        for k in conf:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_gather_keeps_rows_without_id_or_vector(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 9), (4, None), (5, None)], "k int, id int")
    vectors = spark.createDataFrame([(5, [1.0]), (7, [2.0])], "id int, v array<double>")
    got = sorted((r.k, r.id, r.v) for r in gather(rows, "id", vectors, "v", ["k"]).select("k", "id", "v").collect())
    assert got == [(1, 5, [1.0]), (2, 5, [1.0]), (3, 9, None), (4, None, None), (5, None, None)]
    assert gather(rows.where("false"), "id", vectors, "v", ["k"]).count() == 0


@pytest.mark.parametrize("size", [16 << 20, 400])                   # all ids in place; few, and heavy ones dealt
def test_gather_shuffles_no_row_of_a_frequent_id(spark, monkeypatch, size):
    from numweave.operators import gather as G

    monkeypatch.setattr(G, "FREQUENT_BYTES", size)
    monkeypatch.setattr(G, "SHARES", 50)
    rows = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id") % 40).alias("id")).checkpoint()
    vectors = spark.range(20).select(F.col("id"), F.array(F.col("id").cast("double")).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = gather(rows, "id", vectors, "v", ["k"])
        moved = {r.id for r in got.collect() if r.v and r.v != [float(r.id)] or (r.v is None) != (r.id >= 20)}
        assert not moved and got.count() == 2000
        # rows of the most frequent id lie where they lay before: in the partitions of the pinned table
        here = {(r.k, r.p) for r in rows.where("id = 7").select("k", F.spark_partition_id().alias("p")).collect()}
        assert {(r.k, r.p) for r in got.where("id = 7").select("k", F.spark_partition_id().alias("p")).collect()} == here
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
