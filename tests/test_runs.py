import os
import tempfile

from pyspark.sql import functions as F

from numweave.operators import runs as R
from numweave.sources import logs as LG

NS = ("2025-01-01 00:00:00 - INFO - Namespace(batch_size=512, model='org/some-model', num_train_samples={n}, "
      "period_base_list=[{p}], epochs=100)")
FIXTURE_OK = [
    NS.format(n=6400, p="10.0"),
    "2025-01-01 00:00:01 - INFO - Actual model size (total parameters): 37.55M",
    "2025-01-01 00:00:02 - INFO - Train dataset length: 720000, Test dataset length: 200000",
    "2025-01-01 00:00:03 - INFO - Test Loss                               0.0123",
    "2025-01-01 00:00:03 - INFO - Whole Num Acc                           98.500000%",
    "2025-01-01 00:00:03 - INFO - R^2                                     0.999912345678901",
    "2025-01-01 00:00:09 - INFO - Whole Num Accuracy                      99.250000%",
]
FIXTURE_NAN = FIXTURE_OK + ["2025-01-01 00:00:09 - INFO - Train Loss                              nan"]
FIXTURE_NONE = [NS.format(n="None", p="2, 5"),
                "2025-01-01 00:00:02 - INFO - Train dataset length: 720000, Test dataset length: 200000",
                "2025-01-01 00:00:09 - INFO - Whole Number Accuracy                   100.000000%"]


def _write_tree(root, files):
    for rel, lines in files.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as fh:
            fh.write("\n".join(lines) + "\n")


def test_run_summary_from_log_tree(spark):
    root = tempfile.mkdtemp(prefix="numweave-logs-")
    _write_tree(root, {
        "periodic/run1_addlinear_True/training_log_20250101.log": ["old"] ,
        "periodic/run1_addlinear_True/training_log_20250102.log": FIXTURE_OK,
        "periodic/run2_addlinear_False/training_log_20250101.log": FIXTURE_NAN,
        "regular/run3_usedigitwisetokenizer_True/training_log_20250101.log": FIXTURE_NONE,
        "periodic/run1_addlinear_True/notes.txt": ["ignored"],
    })
    lines = LG.src_run_logs(spark, root)
    assert lines.filter(F.col("path").endswith(".txt")).count() == 0
    first = lines.filter((F.col("line_no") == 0) & F.col("path").endswith("20250102.log")).first()
    assert first.line.startswith("2025-01-01 00:00:00") and first.path == "periodic/run1_addlinear_True/training_log_20250102.log"
    s = {r.run_dir: r for r in R.run_summary(lines).collect()}
    assert set(s) == {"periodic/run1_addlinear_True", "regular/run3_usedigitwisetokenizer_True"}   # nan run dropped
    a = s["periodic/run1_addlinear_True"]
    assert (a.method, a.datasize, a.accuracy, a.r2, a.model_size, a.period_base_list, a.add_linear) == (
        "periodic", 6400, 99.25, 0.999912345678901, 37.55, "10.0", "addlinear_True")
    b = s["regular/run3_usedigitwisetokenizer_True"]
    # num_train_samples=None falls back to the train length; digit-wise label
    assert (b.method, b.datasize, b.accuracy, b.add_linear) == ("regular (Digit-Wise)", 720000, 100.0, "addlinear_False")
    assert b.model_name == "some-model"


def test_curve_tables(spark):
    rows = [("r1", "periodic", "10", "addlinear_True", 100, 90.0, 0.9, 1.0, "m", False),
            ("r2", "periodic", "10", "addlinear_False", 100, 80.0, 0.8, 1.0, "m", False),
            ("r3", "periodic", None, "addlinear_True", 200, 100.0, 1.0, 1.0, "m", False),
            ("r4", "logscale", "2, 5", "addlinear_True", 200, None, None, 2.0, "gpt", True)]
    df = spark.createDataFrame(rows, "run_dir string, method string, period_base_list string, add_linear string, "
                                     "datasize bigint, accuracy double, r2 double, model_size double, "
                                     "model_name string, pretrained boolean")
    u = R.union_runs([df])
    assert {r.method for r in u.collect()} == {"periodic", "Finetuned on gpt"}
    best = {(r.method, r.period_base_list): r.best for r in R.best_per_method_period(u).collect()}
    assert best == {("periodic", "10"): 90.0, ("Finetuned on gpt", "2, 5"): float("-inf")}   # NULL period dropped
    diff = R.join_ablation_diff(u).collect()
    assert [(r.datasize, r.accuracy_diff) for r in diff] == [(100, 10.0)]
    assert R.perfect_points(u).count() == 1
    need = {r.method: r.min_datasize for r in R.data_to_target(u, 99.0).collect()}
    assert need == {"periodic": 200, "Finetuned on gpt": None}
    ranks = [(r.rank, r.method) for r in R.rank_methods(u).orderBy("rank").collect()]
    assert ranks == [(1, "periodic"), (2, "Finetuned on gpt")]


def test_ablation_join_deals_a_heavy_x(spark):
    """x = 100 holds most runs of both sides: same rows as a plain join, over many join keys."""
    def runs(n, flag):
        return spark.range(n).select(F.concat(F.lit(flag), F.col("id")).alias("run_dir"), F.lit("m").alias("method"), F.lit(flag).alias("add_linear"),
                                     F.when(F.col("id") % 10 < 8, 100).when(F.col("id") % 10 == 8, F.col("id")).alias("datasize"),
                                     F.col("id").cast("double").alias("accuracy"))

    u = runs(400, "addlinear_True").unionByName(runs(300, "addlinear_False"))
    got = R.join_ablation_diff(u)
    t, f = (u.where(F.col("add_linear") == x).select("datasize", "run_dir", "accuracy") for x in ("addlinear_True", "addlinear_False"))
    want = t.alias("t").join(f.alias("f"), "datasize").select("datasize", F.col("t.run_dir").alias("a"), F.col("f.run_dir").alias("b"))
    same = got.select("datasize", F.col("run_dir_true").alias("a"), F.col("run_dir_false").alias("b"))
    assert same.count() == want.count() == 320 * 240 + 30
    assert same.exceptAll(want).isEmpty()
    xs = [r.datasize for r in got.select("datasize").collect()]
    assert xs == sorted(xs)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_task = [r["count"] for r in R.join_ablation_diff(u).groupBy(F.spark_partition_id()).count().collect()]
        assert max(per_task) < 0.5 * sum(per_task)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
