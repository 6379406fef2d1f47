"""Encoders: number -> vector, as jobs over number tables (inventory 2.7).

Every encoder has the same shape: a number table (``explode_numbers`` output
or any numeric column) -> vectors, as a projection without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import NumberFormat
from ..functions import numeric as N
from ..functions import vector as V


def encode_periodic(df: DataFrame, value_col: str, fmt: NumberFormat, out: str = "vector", shift=0) -> DataFrame:
    """Periodic (cos/sin) features of ``value_col``; zero vector for 0 and
    NULL. A projection: no shuffle, one semantics whatever the data."""
    return df.withColumn(out, V.periodic_features_fmt(value_col, fmt, shift))


def batch_shift(batch_col: str, max_shift: int, seed=0) -> Column:
    """Per-batch length-generalisation shift g in [0, max_shift]."""
    return F.pmod(N.hash_order(seed, batch_col), F.lit(max_shift + 1)).cast("int")


def encode_periodic_shift(df: DataFrame, value_col: str, fmt: NumberFormat, batch_col: str, max_shift: int,
                          seed=0, out: str = "vector") -> DataFrame:
    g = batch_shift(batch_col, max_shift, seed)
    return df.withColumn("shift", g).withColumn(out, V.periodic_features_fmt(value_col, fmt, F.col("shift")))


def encode_digits(df: DataFrame, value_col: str, fmt: NumberFormat, out: str = "vector") -> DataFrame:
    """Truncated digits (least significant first) as floats, zero-padded to
    dim; zero vector for 0."""
    digits = N.digits_truncated(value_col, fmt.int_len, fmt.frac_len)
    vec = F.concat(digits.cast("array<double>"), F.array_repeat(F.lit(0.0), fmt.dim - fmt.n_digits))
    zero = F.array_repeat(F.lit(0.0), fmt.dim)
    return df.withColumn(out, F.when(F.col(value_col) != 0, vec).otherwise(zero))


def encode_logscale(df: DataFrame, vector_col: str, value_col: str, scale, out: str = "vector") -> DataFrame:
    """Token vector times the signed-log-scaled number where that is non-zero,
    else the token vector unchanged."""
    # the factor is materialised as a column first: a scale given as a scalar
    # subquery may not sit inside the higher-order function
    d = df.withColumn("_s", N.signed_log_scale(value_col, scale))
    v = F.col(vector_col).cast("array<double>")
    return d.withColumn(out, F.when(F.col("_s") != 0, V.scale_vector(v, F.col("_s"))).otherwise(v)).drop("_s")


def combine_additive(df: DataFrame, a: str, b: str, out: str = "vector") -> DataFrame:
    return df.withColumn(out, V.add_vectors(a, b))


def layer_norm(df: DataFrame, vector_col: str, out: str = "vector", gamma=None, beta=None) -> DataFrame:
    return df.withColumn(out, V.layer_norm(vector_col, gamma=gamma, beta=beta))


def apply_linear(df: DataFrame, vector_col: str, weight, bias=None, out: str = "vector",
                 enabled: bool = True) -> DataFrame:
    """W v + b with given weights (training them is out of scope). Arrow-batched
    NumPy matmul: one (batch x d) @ (d x d') product per Arrow batch; W is
    shipped once with the function."""
    if not enabled:
        return df.withColumn(out, F.col(vector_col).cast("array<double>"))
    w = np.asarray(weight, dtype=np.float64)
    b = np.zeros(w.shape[0]) if bias is None else np.asarray(bias, dtype=np.float64)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _matmul(vs: pd.Series) -> pd.Series:
        mask = vs.notna().to_numpy()
        out = [None] * len(vs)
        if mask.any():
            x = np.stack([np.asarray(v, dtype=np.float64) for v in vs[mask]])
            y = x @ w.T + b
            for pos, row in zip(np.flatnonzero(mask), y):
                out[pos] = row
        return pd.Series(out, dtype=object)

    return df.withColumn(out, _matmul(F.col(vector_col)))


def filter_nonzero_mask(df: DataFrame, value_col: str, vector_col: str, position_col: str | None = None,
                        out: str | None = None) -> DataFrame:
    """Zero the vector where there is "no number". Reference semantics: a value
    of 0 means no number (a literal 0 in the text is lost too). With
    ``position_col`` (``mask_by_position``) only rows without a position are
    zeroed, so a real 0 keeps its vector."""
    out = out or vector_col
    v = F.col(vector_col)
    zeros = F.transform(v, lambda e: F.lit(0.0))
    keep = F.col(position_col).isNotNull() if position_col else (F.col(value_col) != 0)
    return df.withColumn(out, F.when(keep, v).otherwise(zeros))
