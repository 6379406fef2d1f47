"""Numeric column expressions: stable hash order, digits, log scaling.

Every expression is unrolled over driver-side literals (digit places, powers
of ten) so it stays inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LOG_SCALE_RANGE


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hash_order(seed, *cols) -> Column:
    """Deterministic 60-bit order key: first 15 hex digits of md5("seed:k1:k2...").

    Independent of partitioning (unlike ``rand(seed)``); DuckDB reproduces it
    with ``('0x' || substr(md5(concat_ws(':', seed, k1, ...)), 1, 15))::BIGINT``.
    Keys must be integers or strings (float text differs between engines).
    """
    parts = [F.lit(str(seed))] + [_c(c).cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def hash_uniform(seed, *cols) -> Column:
    """Hash order mapped to [0, 1)."""
    return hash_order(seed, *cols) / F.lit(float(1 << 60))


def floor_div(v, p: int) -> Column:
    """Exact floor division of a BIGINT by a positive literal (integral
    ``div`` of a multiple of p, so no double rounding)."""
    v = _c(v)
    return F.call_function("div", v - F.pmod(v, F.lit(p)), F.lit(p))


def _digit(v: Column, k: int) -> Column:
    if k == 0:
        return F.pmod(v, F.lit(10))
    return F.pmod(floor_div(v, 10 ** k), F.lit(10))


_TWO_63 = float(2 ** 63)


def _to_bigint(d: Column) -> Column:
    """DOUBLE -> BIGINT truncating; NULL (not an ANSI error) when out of range,
    infinite or NaN."""
    return F.when(F.abs(d) < F.lit(_TWO_63), d.cast("bigint"))


def _digits_bigint(d: Column) -> Column:
    """The whole number d as BIGINT; beyond BIGINT its last 18 digits, which a
    double's remainder gives exactly. NULL for infinite and NaN."""
    return (F.when(F.abs(d) < F.lit(_TWO_63), d.cast("bigint"))
            .when(F.abs(d) < F.lit(float("inf")), F.pmod(d, F.lit(1e18)).cast("bigint")))


def scaled_rounded(x, frac_len: int) -> Column:
    """rint(x * 10^f) (half to even), see ``_digits_bigint``."""
    return _digits_bigint(F.rint(_c(x) * F.lit(float(10 ** frac_len))))


def scaled_truncated(x, frac_len: int) -> Column:
    """x * 10^f truncated toward zero (0.29 * 100 -> 28), see ``_digits_bigint``."""
    return _digits_bigint(_c(x) * F.lit(float(10 ** frac_len)))


def digits_of(v, n_digits: int) -> Column:
    """Digits of a BIGINT, least significant first, floor/pmod semantics;
    NULL when the value is NULL."""
    v = _c(v)
    return F.when(v.isNotNull(), F.array(*[_digit(v, k) for k in range(n_digits)]))


def digits_rounded(x, int_len: int, frac_len: int) -> Column:
    return digits_of(scaled_rounded(x, frac_len), int_len + frac_len)


def digits_truncated(x, int_len: int, frac_len: int) -> Column:
    return digits_of(scaled_truncated(x, frac_len), int_len + frac_len)


def log_scale_factor(max_number: float) -> float:
    return LOG_SCALE_RANGE / math.log(1 + max_number)


def signed_log_scale(x, scale) -> Column:
    """scale * ln(1 + |x|) * sign(x); ``scale`` may be a float or a Column."""
    x = _c(x)
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return s * F.log(F.lit(1.0) + F.abs(x)) * F.signum(x)


def signed_log_unscale(p, scale) -> Column:
    """(exp(|p| / scale) - 1) * sign(p)."""
    p = _c(p)
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return (F.exp(F.abs(p) / s) - F.lit(1.0)) * F.signum(p)


def truncate_float(x, decimals: int = 6) -> Column:
    factor = float(10 ** decimals)
    return F.floor(_c(x) * F.lit(factor)) / F.lit(factor)
