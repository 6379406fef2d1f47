"""Vector column expressions: periodic features, layer norm, digit logits,
argmax, dot products. Periods and the digit codebook are driver-side literals
unrolled into the expression (inside whole-stage codegen while small)."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DIGITS, LAYER_NORM_EPS, NumberFormat, codebook, period_list
from . import sqlexpr as S
from .text import _let


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def frequencies(periods) -> list[float]:
    return [2 * math.pi / p for p in periods]


def periodic_features(x, periods, dim: int, shift=0, mask_zero: bool = True) -> Column:
    """[cos(x w0), sin(x w0), cos(x w1), ...] zero-padded to ``dim``; a zero
    vector where x == 0 (0 means "no number"). ``shift`` (int, column name or
    Column g) multiplies x by 10^g first (length generalisation)."""
    if isinstance(x, str) and isinstance(shift, (int, str)):
        sh = None if shift == 0 else (S.q(shift) if isinstance(shift, str) else str(int(shift)))
        return F.expr(S.periodic_features(S.q(x), list(periods), dim, sh, mask_zero))
    if 2 * len(periods) > dim:
        raise ValueError(f"{len(periods)} periods need {2 * len(periods)} > dim={dim}")
    x = _c(x).cast("double")
    if isinstance(shift, Column):
        xs = x * F.pow(F.lit(10.0), shift)
    elif shift:
        xs = x * F.lit(float(10 ** shift))
    else:
        xs = x
    feats = []
    for w in frequencies(periods):
        ph = xs * F.lit(w)
        feats += [F.cos(ph), F.sin(ph)]
    feats += [F.lit(0.0)] * (dim - len(feats))
    vec = F.array(*feats)
    if not mask_zero:
        return vec
    return F.when(x != 0, vec).otherwise(F.array_repeat(F.lit(0.0), dim))


def periodic_features_fmt(x, fmt: NumberFormat, shift=0) -> Column:
    return periodic_features(x, list(fmt.periods), fmt.dim, shift)


def vsum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e)


def layer_norm(v, eps: float = LAYER_NORM_EPS, gamma=None, beta=None) -> Column:
    """(v - mean) / sqrt(var_pop + eps), then * gamma + beta (defaults 1, 0)."""
    if isinstance(v, str) and gamma is None and beta is None:
        return F.expr(S.layer_norm(S.q(v), eps))
    v = _c(v).cast("array<double>")

    def with_mean(vv):
        def with_var(stats):
            mean, var = stats["m"], stats["s"]
            out = F.transform(vv, lambda e: (e - mean) / F.sqrt(var + F.lit(eps)))
            if gamma is not None:
                out = F.zip_with(out, F.array(*[F.lit(float(g)) for g in gamma]), lambda a, b: a * b)
            if beta is not None:
                out = F.zip_with(out, F.array(*[F.lit(float(b)) for b in beta]), lambda a, b: a + b)
            return out

        mean = vsum(vv) / F.size(vv)
        var = F.aggregate(vv, F.lit(0.0), lambda acc, e: acc + (e - mean) * (e - mean)) / F.size(vv)
        return _let(F.struct(mean.alias("m"), var.alias("s")), with_var)

    return _let(v, with_mean)


def digit_logits(h, bases, n_digits: int, offset: int = 0, normalize: bool = True) -> Column:
    """ARRAY<ARRAY<DOUBLE>> [n_digits][10]: slice k of width 2B (starting at
    2B*offset) dotted with every digit's codebook column."""
    if isinstance(h, str):
        return F.expr(S.digit_logits(S.q(h), bases, n_digits, offset, normalize))
    cb = codebook(bases)
    width = 2 * len(bases)

    def body(hv):
        rows = []
        for k in range(n_digits):
            base = width * (offset + k)
            logits = []
            for d in range(DIGITS):
                terms = [hv[base + m] * F.lit(cb[m][d]) for m in range(width)]
                acc = terms[0]
                for t in terms[1:]:
                    acc = acc + t
                logits.append(acc)
            rows.append(F.array(*logits))
        return F.array(*rows)

    hv = layer_norm(h) if normalize else _c(h).cast("array<double>")
    return _let(hv, body)


def argmax_first(v: Column, decimals: int = 9) -> Column:
    """0-based index of the first maximum, comparing values rounded to
    ``decimals`` places (engines then agree on near-ties)."""
    def body(r):
        return F.array_position(r, F.array_max(r)) - F.lit(1)

    return _let(F.transform(v, lambda e: F.round(e, decimals)), body)


def decode_hidden(h: str, bases, n_digits: int, frac_len: int, normalize: bool = True) -> Column:
    """Hidden vector column -> decoded number (layer norm, logits, argmax)."""
    return F.expr(S.decode_logits(S.digit_logits(S.q(h), bases, n_digits, 0, normalize), n_digits, frac_len))


def logsumexp(v: Column) -> Column:
    return _let(F.array_max(v), lambda m: m + F.log(vsum(F.transform(v, lambda e: F.exp(e - m)))))


def dot(a, b) -> Column:
    return vsum(F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: x * y))


def add_vectors(a, b) -> Column:
    return F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: x + y)


def scale_vector(v, s) -> Column:
    s = _c(s)
    return F.transform(_c(v).cast("array<double>"), lambda e: e * s)


# -- weights built from a rule (md5 of "seed:i:j"), identical in SQL ---------
def rule_weight(seed, i: int, j: int, dim: int) -> float:
    h = int(hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:15], 16)
    return (h / float(1 << 60) - 0.5) * 2.0 / math.sqrt(dim)


def rule_matrix(seed, rows: int, cols: int) -> list[list[float]]:
    return [[rule_weight(seed, i, j, cols) for j in range(cols)] for i in range(rows)]


__all__ = [n for n in dir() if not n.startswith("_")] + ["period_list"]
