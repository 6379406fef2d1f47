import math

import pytest
from pyspark.sql import functions as F

from numweave.config import NumberFormat
from numweave.operators import metrics as M

FMT = NumberFormat(int_len=3, frac_len=2, bases=(2.0, 5.0), dim=64)


def _df(spark, pairs):
    rows = [(0, i // 2, float(y), float(p), str(float(y)), str(float(p)), float((p - y) ** 2)) for i, (y, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "run int, batch_id int, label double, prediction double, label_text string, "
                                       "pred_text string, loss double")


def test_constant_labels_r2(spark):
    df = _df(spark, [(5, 5), (5, 6), (5, 4)])
    assert math.isnan(M.agg_r2(df, ["run"]).first().r2)
    assert M.agg_r2(df, ["run"], zero_variance="zero").first().r2 == 0.0
    rep = {m: M.eval_report(df, ["run"], m, FMT).first() for m in M.METHODS}
    assert math.isnan(rep["periodic"].r2) and rep["digits"].r2 == 0.0


def test_tolerance_and_mse_and_r2(spark):
    df = _df(spark, [(1, 1), (2, 2.5), (3, 3.004)])
    r = M.eval_report(df, ["run"], "periodic", FMT).first()
    assert r.whole_number_accuracy == pytest.approx(2 / 3)
    assert r.mse == pytest.approx((0.25 + 0.004 ** 2) / 3)
    assert r.r2 == pytest.approx(1 - (0.25 + 0.004 ** 2) / 2.0)
    assert M.eval_report(df, ["run"], "logscale", FMT).first().whole_number_accuracy == pytest.approx(2 / 3)


def test_char_prefix_shorter_and_longer(spark):
    df = spark.createDataFrame([(0, "12.5", "12.55"), (0, "7.0", "7"), (0, "100.0", "190.0")],
                               "run int, label_text string, pred_text string")
    r = M.acc_char_prefix(df, ["run"]).first()
    # 4 of 4, 1 of 3 (shorter prediction counts as wrong), 4 of 5
    assert r.digit_wise_accuracy == pytest.approx((4 + 1 + 4) / (4 + 3 + 5))
    p = M.acc_char_padded(df, ["run"]).first()
    assert p.digit_wise_accuracy == pytest.approx((4 + 1 + 4) / (5 + 3 + 5))


def test_exact_string_and_numeric_only(spark):
    df = spark.createDataFrame([(0, "3", " 3 "), (0, "4", "x4"), (1, "5", "abc")],
                               "run int, label_text string, pred_text string")
    acc = {r.run: r.whole_number_accuracy for r in M.acc_exact_string(df, ["run"]).collect()}
    assert acc == {0: 0.5, 1: 0.0}
    mse = {r.run: r.mse for r in M.agg_mse_numeric_only(df, ["run"]).collect()}
    assert mse == {0: 0.0, 1: -1.0}


def test_digit_accuracy_truncates(spark):
    df = _df(spark, [(0.29, 0.28)])
    # label digits of 0.29 truncate to 28 as well -> all 5 digits agree
    assert M.acc_digit(df, ["run"], FMT).first().digit_wise_accuracy == 1.0


def test_batch_mean_loss_weighs_batches_equally(spark):
    df = _df(spark, [(0, 1), (0, 1), (0, 3)])   # batches: [1, 1], [9]
    assert M.agg_loss_batch_mean(df, ["run"]).first().test_loss == pytest.approx((1 + 9) / 2)


def test_topk_and_samples(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("run"), F.col("id").alias("idx"),
                                 F.col("id").cast("double").alias("label"),
                                 F.when(F.col("id") % 3 == 0, F.col("id") + 1.0).otherwise(F.col("id").cast("double")).alias("prediction"))
    top = M.topk_mispredictions(df, ["run"], "idx", 5, 0.01).collect()
    for run in (0, 1):
        want = [i for i in range(100) if i % 2 == run and i % 3 == 0][:5]
        assert sorted(r.idx for r in top if r.run == run) == want
    assert M.sample_predictions(df, ["run"], "idx", 3).count() == 6


def test_early_stop(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 1.0), (1, 3, 1.0), (2, 1, 0.2)],
                               "run int, epoch int, whole_number_accuracy double")
    kept = sorted((r.run, r.epoch) for r in M.early_stop_epoch(df, ["run"]).collect())
    assert kept == [(1, 1), (1, 2), (2, 1)]


def test_report_and_vocab_independent_of_partitioning(spark):
    from collections import Counter

    from numweave.operators import text as X

    base = spark.range(400).select((F.col("id") % 3).alias("run"), (F.col("id") / 7).cast("int").alias("batch_id"),
                                   (F.col("id") * 1.25).alias("label"),
                                   (F.col("id") * 1.25 + (F.col("id") % 4) * 0.5).alias("prediction"))
    base = base.withColumn("label_text", F.col("label").cast("string")) \
               .withColumn("pred_text", F.col("prediction").cast("string")) \
               .withColumn("loss", F.pow(F.col("prediction") - F.col("label"), 2))
    outs = []
    for n in (1, 7, 64):
        r = M.eval_report(base.repartition(n), ["run"], "periodic", FMT).collect()
        outs.append(sorted((x.run, x.n, round(x.whole_number_accuracy, 12), round(x.mse, 9)) for x in r))
    assert outs[0] == outs[1] == outs[2]
    words = spark.createDataFrame([(w,) for w in "a b b c c c d d d d e".split()], "token string")
    vs = [Counter((r.token, r.id) for r in X.vocab_build(words.repartition(n)).collect()) for n in (1, 7, 64)]
    assert vs[0] == vs[1] == vs[2]
