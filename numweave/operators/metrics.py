"""Evaluation metrics over prediction tables (inventory 2.9).

Every metric is an aggregate with map-side partial aggregation: a hot run
(a third of all rows) is pre-aggregated in every task before the shuffle, so
no task ever holds a whole group. ``eval_reports`` computes all metrics of all
methods, the batch-mean loss included (mean of per-batch means, as the
reference averages its loader's batch losses), in one pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LOG_METHOD_TOLERANCE, NumberFormat
from ..functions import numeric as N
from ..functions import text as T
from .order import top_k_per_group


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strip(c) -> Column:
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def within_tolerance(label, pred, tol: float) -> Column:
    return F.abs(_c(pred) - _c(label)) < F.lit(float(tol))


def char_prefix_matches(actual, pred) -> Column:
    """Positions i < min(len(actual), len(pred)) with equal characters."""
    if isinstance(actual, str) and isinstance(pred, str):
        a, p = f"`{actual}`", f"`{pred}`"
        m = f"least(length({a}), length({p}))"
        return F.expr(f"CASE WHEN {m} > 0 THEN size(filter(sequence(1, {m}), "
                      f"i -> substr({a}, i, 1) = substr({p}, i, 1))) ELSE 0 END")
    a, p = _c(actual), _c(pred)
    m = F.least(F.length(a), F.length(p))
    hits = F.size(F.filter(F.sequence(F.lit(1), m), lambda i: a.substr(i, F.lit(1)) == p.substr(i, F.lit(1))))
    return F.when(m > 0, hits).otherwise(F.lit(0))


def char_padded_matches(actual, pred) -> Column:
    """Both right-padded with spaces to the longer length; equal positions."""
    if isinstance(actual, str) and isinstance(pred, str):
        a, p = f"`{actual}`", f"`{pred}`"
        m = f"greatest(length({a}), length({p}))"
        ca = f"CASE WHEN i <= length({a}) THEN substr({a}, i, 1) ELSE ' ' END"
        cp = f"CASE WHEN i <= length({p}) THEN substr({p}, i, 1) ELSE ' ' END"
        return F.expr(f"CASE WHEN {m} > 0 THEN size(filter(sequence(1, {m}), i -> ({ca}) = ({cp}))) ELSE 0 END")
    a, p = _c(actual), _c(pred)
    la, lp = F.length(a), F.length(p)
    m = F.greatest(la, lp)

    def ch(s, n, i):
        return F.when(i <= n, s.substr(i, F.lit(1))).otherwise(F.lit(" "))

    hits = F.size(F.filter(F.sequence(F.lit(1), m), lambda i: ch(a, la, i) == ch(p, lp, i)))
    return F.when(m > 0, hits).otherwise(F.lit(0))


def digit_matches(label, pred, fmt: NumberFormat) -> Column:
    """Equal truncated digits over the I+f places (unrolled, codegen-friendly)."""
    if isinstance(label, str) and isinstance(pred, str):
        from ..functions.sqlexpr import d, to_bigint

        a = to_bigint(f"(cast(`{label}` as double) * {d(10 ** fmt.frac_len)})")
        b = to_bigint(f"(cast(`{pred}` as double) * {d(10 ** fmt.frac_len)})")

        def dig(v, k):
            return f"pmod({v}, 10)" if k == 0 else f"pmod((({v}) - pmod({v}, {10 ** k})) div {10 ** k}, 10)"

        return F.expr(" + ".join(f"CASE WHEN {dig(a, k)} = {dig(b, k)} THEN 1 ELSE 0 END"
                                 for k in range(fmt.n_digits)))
    a = N.scaled_truncated(label, fmt.frac_len)
    b = N.scaled_truncated(pred, fmt.frac_len)
    terms = [F.when(N._digit(a, k) == N._digit(b, k), 1).otherwise(0) for k in range(fmt.n_digits)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def acc_tolerance(df: DataFrame, group_cols, tol: float, label="label", pred="prediction") -> DataFrame:
    return df.groupBy(*group_cols).agg(
        F.avg(F.when(within_tolerance(label, pred, tol), 1.0).otherwise(0.0)).alias("whole_number_accuracy"))


def acc_exact_string(df: DataFrame, group_cols, label_text="label_text", pred_text="pred_text") -> DataFrame:
    return df.groupBy(*group_cols).agg(
        F.avg(F.when(_strip(label_text) == _strip(pred_text), 1.0).otherwise(0.0)).alias("whole_number_accuracy"))


def acc_char_prefix(df: DataFrame, group_cols, label_text="label_text", pred_text="pred_text") -> DataFrame:
    return df.groupBy(*group_cols).agg(
        (F.sum(char_prefix_matches(label_text, pred_text)) / F.sum(F.length(label_text))).alias(
            "digit_wise_accuracy"))


def acc_char_padded(df: DataFrame, group_cols, label_text="label_text", pred_text="pred_text") -> DataFrame:
    a, p = _strip(label_text), _strip(pred_text)
    return df.groupBy(*group_cols).agg(
        (F.sum(char_padded_matches(a, p)) / F.sum(F.greatest(F.length(a), F.length(p)))).alias(
            "digit_wise_accuracy"))


def acc_digit(df: DataFrame, group_cols, fmt: NumberFormat, label="label", pred="prediction") -> DataFrame:
    return df.groupBy(*group_cols).agg(
        (F.sum(digit_matches(label, pred, fmt)) / (F.count(F.lit(1)) * F.lit(fmt.n_digits))).alias(
            "digit_wise_accuracy"))


def agg_mse(df: DataFrame, group_cols, label="label", pred="prediction") -> DataFrame:
    return df.groupBy(*group_cols).agg(F.avg(F.pow(_c(pred) - _c(label), 2)).alias("mse"))


def agg_mse_numeric_only(df: DataFrame, group_cols, label_text="label_text", pred_text="pred_text") -> DataFrame:
    """MSE over rows whose prediction is numeric text; -1 when there are none."""
    ok = T.is_numeric_text(_strip(pred_text))
    err = F.pow(_strip(pred_text).cast("double") - _strip(label_text).cast("double"), 2)
    return df.groupBy(*group_cols).agg(F.coalesce(F.avg(F.when(ok, err)), F.lit(-1.0)).alias("mse"))


def _r2(sse: Column, tv: Column, n: Column, zero_variance: str) -> Column:
    if zero_variance == "zero":
        return F.when(tv != 0, F.lit(1.0) - sse / tv).otherwise(F.lit(0.0))
    ok = tv > 0
    if zero_variance == "nan_small":
        ok = ok & (n > 1)
    return F.when(ok, F.lit(1.0) - sse / tv).otherwise(F.lit(float("nan")))


def _tv(y: Column) -> Column:
    """Total variance sum((y - mean)^2): exactly 0 when all labels are equal,
    else var_pop * n (Spark's stable central-moment aggregate)."""
    return F.when(F.min(y) == F.max(y), F.lit(0.0)).otherwise(F.var_pop(y) * F.count(y))


def agg_r2(df: DataFrame, group_cols, label="label", pred="prediction", zero_variance: str = "nan") -> DataFrame:
    """1 - SSE / sum((y - mean)^2). ``zero_variance``: "nan" (periodic, text),
    "nan_small" (log-scale: also NaN for n <= 1), "zero" (digit method)."""
    y = _c(label)
    sse = F.sum(F.pow(_c(pred) - y, 2))
    return df.groupBy(*group_cols).agg(_r2(sse, _tv(y), F.count(y), zero_variance).alias("r2"))


def agg_loss_batch_mean(df: DataFrame, group_cols, batch_col="batch_id", loss_col="loss") -> DataFrame:
    """Mean over batches of the per-batch mean loss (a partial last batch
    weighs as much as a full one)."""
    per_batch = df.groupBy(*group_cols, batch_col).agg(F.avg(loss_col).alias("_bl"))
    return per_batch.groupBy(*group_cols).agg(F.avg("_bl").alias("test_loss"))


METHODS = ("periodic", "logscale", "digits", "regular")


def _text(c) -> Column:
    return T.py_float_str(c)


def _features(df: DataFrame, keys, methods, fmt: NumberFormat, label, pred, label_text, pred_text, batch, loss) -> DataFrame:
    """Per-row inputs of all metrics, each computed once: _acc, _hit, _len of
    every method; _y, _p (numbers) and _ry, _rp (numbers read from texts)."""
    numeric, regular = any(m != "regular" for m in methods), "regular" in methods
    prefix = "periodic" in methods or "logscale" in methods
    base = df.select(*keys, batch.alias("_batch"), loss.alias("_loss"),
                     *([_c(label).alias("_y"), _c(pred).alias("_p")] if numeric else []),
                     *([_text(label).alias("_lt"), _text(pred).alias("_pt")] if prefix else []),
                     *([_strip(label_text).alias("_a"), _strip(pred_text).alias("_b")] if regular else []))
    y, p, ok = F.col("_y"), F.col("_p"), T.is_numeric_text("_b") if regular else None
    acc, hit, size = {}, {}, {}
    for m in methods:
        if m == "regular":
            acc[m], hit[m], size[m] = F.col("_a") == F.col("_b"), char_padded_matches("_a", "_b"), F.greatest(F.length("_a"), F.length("_b"))
        else:
            acc[m] = within_tolerance(y, p, LOG_METHOD_TOLERANCE if m == "logscale" else fmt.tolerance)
            hit[m] = digit_matches("_y", "_p", fmt) if m == "digits" else char_prefix_matches("_lt", "_pt")
            size[m] = F.lit(fmt.n_digits) if m == "digits" else F.length("_lt")
    return base.select(
        *keys, "_batch", "_loss",
        *[c.alias(f"_{n}_{m}") for m in methods for n, c in (("acc", F.when(acc[m], 1.0).otherwise(0.0)), ("hit", hit[m]), ("len", size[m]))],
        *(["_y", "_p"] if numeric else []),
        *([F.when(ok, F.col("_a").cast("double")).alias("_ry"), F.when(ok, F.col("_b").cast("double")).alias("_rp")] if regular else []))


def _merged(parts: Column) -> Column:
    """Struct n, mean, m2 of all (n, mean, m2) parts: central moments merged
    pairwise, in a fixed order, without subtracting large sums."""
    def add(acc, x):
        n, delta = acc["n"] + x["n"], x["mean"] - acc["mean"]
        return F.struct(n.alias("n"), (acc["mean"] + delta * x["n"] / n).alias("mean"),
                        (acc["m2"] + x["m2"] + delta * delta * acc["n"] * x["n"] / n).alias("m2"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(F.filter(F.array_sort(parts), lambda x: x["n"] > 0), zero, add)


def eval_reports(df: DataFrame, group_cols, fmt: NumberFormat, label="label", pred="prediction", label_text="label_text",
                 pred_text="pred_text", batch_col="batch_id", loss_col="loss", methods=METHODS) -> DataFrame:
    """All metrics of every method: method, group_cols, n, whole_number_accuracy,
    digit_wise_accuracy, mse, r2, test_loss.

    One pass over the rows: everything is aggregated per (group, batch), where
    the batch-mean loss arises and where most rows of a batch lie in one task,
    and merged to groups from there: sums add up, central moments of the labels
    are merged. Batches with equal numbers of labels are merged by Spark's own
    variance of their means; the few kinds that are left (a batch has at most so
    many sizes) are merged pairwise."""
    keys, methods = list(group_cols), list(methods)
    batch = _c(batch_col) if batch_col is not None and loss_col is not None else F.lit(0)
    loss = _c(loss_col) if loss_col is not None else F.lit(None).cast("double")
    rows = _features(df, keys, methods, fmt, label, pred, label_text, pred_text, batch, loss)
    sides = [x for x in (("_y", "_p"), ("_ry", "_rp")) if x[0] in rows.columns]
    sums = [f"_{n}_{m}" for m in methods for n in ("acc", "hit", "len")]
    first = [F.count(F.lit(1)).alias("n"), F.avg("_loss").alias("_bl"), *[F.sum(c).alias(c) for c in sums]]
    for y, p in sides:
        err = F.pow(F.col(p) - F.col(y), 2)
        first += [F.sum(err).alias(f"{y}_sq"), F.count(err).alias(f"{y}_nsq"), F.count(y).alias(f"{y}_n"), F.avg(y).alias(f"{y}_mean"),
                  F.var_pop(y).alias(f"{y}_var"), F.min(y).alias(f"{y}_min"), F.max(y).alias(f"{y}_max")]
    batches = rows.groupBy(*keys, "_batch").agg(*first)
    sums += ["n"] + [f"{y}_{s}" for y, _ in sides for s in ("sq", "nsq")]
    second = [F.sum("_bl").alias("_bl"), F.count("_bl").alias("_nbl"), *[F.sum(c).alias(c) for c in sums]]
    third = [F.sum("_bl").alias("_bl"), F.sum("_nbl").alias("_nbl"), *[F.sum(c).alias(c) for c in sums]]
    for y, _ in sides:
        n, count = F.col(f"{y}_n"), F.count(F.lit(1))
        m2 = F.sum(F.col(f"{y}_var") * n) + F.first(n) * F.var_pop(f"{y}_mean") * count
        second += [F.struct((F.first(n) * count).cast("double").alias("n"), F.avg(f"{y}_mean").alias("mean"), F.coalesce(m2, F.lit(0.0)).alias("m2"))
                   .alias(f"{y}_part"), F.min(f"{y}_min").alias(f"{y}_min"), F.max(f"{y}_max").alias(f"{y}_max")]
        third += [_merged(F.collect_list(f"{y}_part")).alias(f"{y}_all"), F.min(f"{y}_min").alias(f"{y}_min"), F.max(f"{y}_max").alias(f"{y}_max")]
    kinds = batches.groupBy(*keys, *[F.col(f"{y}_n") for y, _ in sides]).agg(*second)
    whole = kinds.groupBy(*keys).agg(*third)
    records = []
    for m in methods:
        y = "_ry" if m == "regular" else "_y"
        sse, moments = F.col(f"{y}_sq"), F.col(f"{y}_all")
        tv = F.when(F.col(f"{y}_min") == F.col(f"{y}_max"), F.lit(0.0)).when(moments["n"] > 0, moments["m2"])
        mse = F.try_divide(sse, F.col(f"{y}_nsq"))
        zero = {"periodic": "nan", "logscale": "nan_small", "digits": "zero", "regular": "nan"}[m]
        records.append(F.struct(
            F.lit(m).alias("method"), (F.col(f"_acc_{m}") / F.col("n")).alias("whole_number_accuracy"),
            (F.col(f"_hit_{m}") / F.col(f"_len_{m}")).alias("digit_wise_accuracy"),
            (F.coalesce(mse, F.lit(-1.0)) if m == "regular" else mse).alias("mse"), _r2(sse, tv, moments["n"], zero).alias("r2")))
    out = whole.select(*keys, "n", F.try_divide(F.col("_bl"), F.col("_nbl")).alias("test_loss"), F.explode(F.array(*records)).alias("r"))
    return out.select("r.method", *keys, "n", "r.whole_number_accuracy", "r.digit_wise_accuracy", "r.mse", "r.r2",
                      *(["test_loss"] if loss_col is not None else []))


def eval_report(df: DataFrame, group_cols, method: str, fmt: NumberFormat, label="label", pred="prediction",
                label_text="label_text", pred_text="pred_text", batch_col="batch_id", loss_col="loss") -> DataFrame:
    """``eval_reports`` of one method, one record per group."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    return eval_reports(df, group_cols, fmt, label, pred, label_text, pred_text, batch_col, loss_col, [method]).drop("method")


def topk_mispredictions(df: DataFrame, group_cols, idx: str, k: int, tol: float, label="label",
                        pred="prediction") -> DataFrame:
    """First k rows (input order) outside the tolerance, per group."""
    wrong = df.filter(~F.coalesce(within_tolerance(label, pred, tol), F.lit(False)))
    return top_k_per_group(wrong, group_cols, [idx], k, rank_col="rank")


def sample_predictions(df: DataFrame, group_cols, idx: str, k: int) -> DataFrame:
    """First k (prediction, label) pairs per group, right or wrong."""
    return top_k_per_group(df, group_cols, [idx], k, rank_col="rank")


def early_stop_epoch(metrics: DataFrame, run_cols, epoch="epoch", acc="whole_number_accuracy") -> DataFrame:
    """Epoch records up to the first one with accuracy exactly 1.0 (training
    stops there); runs that never reach it keep every epoch."""
    run_cols = list(run_cols)
    stops = metrics.groupBy(*run_cols).agg(F.min(F.when(F.col(acc) == 1.0, F.col(epoch))).alias("stop_epoch"))
    j = metrics.join(stops, run_cols, "left")
    return j.filter(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
