"""Decoders and losses: vector -> digits / number / loss (inventory 2.8).

Row-level decoding is a projection (no shuffle); batch losses aggregate by
``batch_id`` (partial aggregation), then average over batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NumberFormat
from ..functions import numeric as N
from ..functions import sqlexpr as SX
from ..functions import vector as V


def digit_logits(df: DataFrame, hidden_col: str, fmt: NumberFormat, offset: int = 0, normalize: bool = True,
                 out: str = "logits") -> DataFrame:
    return df.withColumn(out, V.digit_logits(hidden_col, list(fmt.bases), fmt.n_digits, offset, normalize))


def decode_periodic(df: DataFrame, hidden_col: str, fmt: NumberFormat, normalize: bool = True,
                    out: str = "prediction") -> DataFrame:
    """argmax digit per slice (first maximum wins), sum d_k 10^(k - f)."""
    return df.withColumn(out, V.decode_hidden(hidden_col, list(fmt.bases), fmt.n_digits, fmt.frac_len, normalize))


def loss_digit_ce(df: DataFrame, hidden_col: str, label_col: str, fmt: NumberFormat, batch_col: str = "batch_id",
                  group_cols=(), offset: int = 0) -> DataFrame:
    """Per batch: mean over rows x digits of the digit cross-entropy.
    ``offset``: slices by which a shifted encoding moved the digits up."""
    logits = SX.digit_logits(SX.q(hidden_col), list(fmt.bases), fmt.n_digits, offset, True)
    digits = SX.digits_rounded(SX.q(label_col), fmt.int_len, fmt.frac_len)
    per_row = df.withColumn("_ce", F.expr(SX.digit_ce(logits, digits, fmt.n_digits)))
    return per_row.groupBy(*group_cols, batch_col).agg(F.avg("_ce").alias("loss"))


def decode_digits(df: DataFrame, hidden_col: str, fmt: NumberFormat, out: str = "prediction") -> DataFrame:
    """Digit i = rint(h[i]) mod 10; value = sum d_i 10^i / 10^f."""
    h = F.col(hidden_col).cast("array<double>")
    total = None
    for i in range(fmt.n_digits):
        d = F.pmod(N._to_bigint(F.rint(h[i])), F.lit(10)) * F.lit(10 ** i)
        total = d if total is None else total + d
    return df.withColumn(out, total / F.lit(float(10 ** fmt.frac_len)))


def loss_digit_rms(df: DataFrame, hidden_col: str, label_col: str, fmt: NumberFormat, batch_col: str = "batch_id",
                   group_cols=()) -> DataFrame:
    """Per batch: sqrt(mean over rows x digits of (h[i] - digit_i(label))^2)."""
    h = F.col(hidden_col).cast("array<double>")
    digits = N.digits_truncated(F.col(label_col).cast("double"), fmt.int_len, fmt.frac_len)
    sq = None
    for i in range(fmt.n_digits):
        t = F.pow(h[i] - digits[i].cast("double"), 2)
        sq = t if sq is None else sq + t
    per_row = df.withColumn("_sq", sq)
    return per_row.groupBy(*group_cols, batch_col).agg(
        F.sqrt(F.sum("_sq") / (F.count(F.lit(1)) * F.lit(fmt.n_digits))).alias("loss"))


def head_linear(df: DataFrame, hidden_col: str, weight, bias: float = 0.0, out: str = "head") -> DataFrame:
    w = F.array(*[F.lit(float(x)) for x in weight])
    return df.withColumn(out, V.dot(hidden_col, w) + F.lit(float(bias)))


def loss_log_mse(df: DataFrame, head_col: str, label_col: str, scale, batch_col: str = "batch_id",
                 group_cols=()) -> DataFrame:
    target = N.signed_log_scale(F.col(label_col).cast("double"), scale)
    return df.groupBy(*group_cols, batch_col).agg(F.avg(F.pow(F.col(head_col) - target, 2)).alias("loss"))


def decode_logscale(df: DataFrame, head_col: str, scale, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, N.signed_log_unscale(head_col, scale))
