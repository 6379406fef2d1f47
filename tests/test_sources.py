import tempfile
from collections import Counter

from pyspark.sql import functions as F

from numweave.operators import generate as G
from numweave.operators import split as P
from numweave.sources import datasets as DS
from numweave.sources import logs as LG
from numweave.sources import sinks as SK
from numweave.sources.paths import scratch_path
from numweave.streaming import numbers as ST


def _qa(spark):
    qa = G.gen_pairs_add(spark.range(3000).withColumnRenamed("id", "k"), ["k"], 10000, 1000, seed=5)
    return P.split_positional(P.index_by_hash(qa, ["question"], seed=6)).drop("idx")


def test_split_csv_round_trip(spark):
    path = scratch_path(spark, "t-splits")
    qa = _qa(spark)
    DS.sink_split_csv(qa, path)
    back = DS.src_split_dataset(spark, path)
    assert Counter(map(tuple, back.select("question", "label", "split").collect())) == \
        Counter(map(tuple, qa.select("question", "label", "split").collect()))
    assert Counter(r.split for r in back.collect()) == {"train": 720, "validation": 80, "test": 200}


def test_loader_carves_test_split_when_missing(spark):
    path = scratch_path(spark, "t-train-only")
    DS.sink_split_csv(_qa(spark).filter(F.col("split") == "train"), path)
    back = DS.src_split_dataset(spark, path)
    c = Counter(r.split for r in back.collect())
    assert set(c) == {"train", "test"} and c["train"] + c["test"] == 720


def test_quarantine_sink(spark):
    df = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, float("inf")), (4, None)], "k int, loss double")
    qpath = scratch_path(spark, "t-quarantine")
    good = SK.sink_quarantine(df, ["loss"], qpath)
    assert sorted(r.k for r in good.collect()) == [1, 4]
    assert sorted(r.k for r in SK.read_quarantine(spark, qpath, df.schema).collect()) == [2, 3]


def test_decimal_labels_survive_and_bad_ones_fail(spark):
    import pytest

    path = scratch_path(spark, "t-decimal")
    df = spark.createDataFrame([("a", 3.5, "test"), ("b", 2.0, "train")], "question string, label double, split string")
    DS.sink_split_csv(df, path)
    assert sorted(map(tuple, DS.src_split_dataset(spark, path).select("question", "label").collect())) == [("a", 3.5), ("b", 2.0)]
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        DS.src_split_dataset(spark, path, DS.INTEGER_QA_SCHEMA).collect()


def test_foreach_batch_quarantine(spark):
    src = tempfile.mkdtemp()
    spark.createDataFrame([(1, 0.5), (2, float("nan"))], "k int, loss double").write.mode("overwrite").parquet(src + "/in")
    stream = spark.readStream.schema("k int, loss double").parquet(src + "/in")
    good, bad, ck = src + "/good", src + "/bad", src + "/ck"
    q = (stream.writeStream.foreachBatch(ST.quarantine_batches(["loss"], good, bad))
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert [r.k for r in spark.read.parquet(good + "/epoch=0").collect()] == [1]
    assert [r.k for r in spark.read.parquet(bad + "/epoch=0").collect()] == [2]


def test_metrics_batches_count_once(spark, monkeypatch):
    monkeypatch.setattr(SK, "FILE_ROWS", 50)
    path = scratch_path(spark, "t-metrics")
    a = spark.range(300).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("run"), F.col("id").alias("epoch"))
    b = spark.range(5).select(F.lit("other").alias("run"), (F.col("id") + 1000).alias("epoch"))
    first = SK.sink_metrics(a, path)
    assert SK.sink_metrics(a.repartition(7), path) == first                      # the same rows again
    SK.sink_metrics(b, path, batch_id="b")
    SK.sink_metrics(b, path, batch_id="b")
    # an attempt that never committed, and two writers that commit the same batch
    b.withColumn("run_bucket", F.lit(0)).write.partitionBy("run_bucket").parquet(f"{path}/rows/attempt=lost")
    b.withColumn("run_bucket", F.lit(0)).write.partitionBy("run_bucket").parquet(f"{path}/rows/attempt=late")
    spark.createDataFrame([("b", "late", 9e18)], SK.MANIFEST).write.mode("append").parquet(f"{path}/manifest")
    got = Counter(tuple(r) for r in SK.read_metrics(spark, path).collect())
    assert got == Counter([tuple(r) for r in a.collect()] + [tuple(r) for r in b.collect()])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # small partitions stay apart
    try:
        SK.sink_metrics(a.where("run = 'hot'"), path + "-hot")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.parquet(f"{path}-hot/rows").inputFiles()) > 1
    assert SK.read_metrics(spark, path).columns == ["run", "epoch"]


def test_large_logs_are_numbered_over_splits(spark):
    root = tempfile.mkdtemp()
    want = {}
    for name, lines in (("a/big.log", [f"line {i} " + "x" * (i % 70) for i in range(20000)]), ("b/small.log", ["one", "", "three"]), ("c/empty.log", [])):
        import os

        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w", newline="") as f:
            f.write(("\r\n" if name[0] == "b" else "\n").join(lines) + ("\n" if lines and name[0] == "a" else ""))
        want[name] = lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        scan = spark.read.option("recursiveFileLookup", "true").text(root)
        assert scan.select(F.col("_metadata.file_block_start").alias("s")).distinct().count() > 5
        got = {}
        for r in LG.src_run_logs(spark, root).collect():
            got.setdefault(r.path, {})[r.line_no] = r.line
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {k: dict(enumerate(v)) for k, v in want.items() if v}


def test_written_logs_keep_path_and_order_and_are_one_file_each(spark, tmp_path):
    import os

    root = str(tmp_path / "logs")
    rows = [(p, i, f"{p} {i}" if i % 7 else "") for p in ("a/run+1", "b=c/50% x", "d") for i in range(300)]
    for part in (rows[:400], rows):                                 # the second tree replaces the first
        LG.write_run_logs(spark.createDataFrame(part, "path string, line_no int, line string").repartition(8), root)
        got = sorted((r.path, r.line_no, r.line) for r in LG.read_written_logs(spark, root).collect())
        assert got == sorted(part)
    files = [f for _, _, names in os.walk(root) for f in names]
    assert len(files) == 3 and not any(f.endswith(".crc") for f in files)     # no side files, no job end that moves them
