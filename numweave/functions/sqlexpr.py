"""Large column expressions as Spark SQL text, parsed once with ``F.expr``.

Building an expression of a few hundred nodes through the Column API costs
one JVM round trip per node (seconds for the digit-logit matrix); the same
expression as SQL text is parsed in one call. Inputs are SQL expressions
(usually a column name); doubles are written as exact ``D`` literals.
Single-element ``transform(array(v), x -> ...)[0]`` binds a value once so
that repeated references do not duplicate work or generated code.
"""

from __future__ import annotations

import math

from ..config import DIGITS, LAYER_NORM_EPS, codebook

_counter = [0]


def _fresh(prefix: str) -> str:
    _counter[0] += 1
    return f"{prefix}{_counter[0]}"


def d(v: float) -> str:
    """Exact Spark SQL DOUBLE literal."""
    v = float(v)
    if math.isnan(v):
        return "double('NaN')"
    if math.isinf(v):
        return "double('Infinity')" if v > 0 else "double('-Infinity')"
    return f"{v!r}D"


def q(name: str) -> str:
    return f"`{name}`"


def let(value: str, body) -> str:
    var = _fresh("v")
    return f"transform(array({value}), {var} -> {body(var)})[0]"


def vsum(arr: str) -> str:
    a, e = _fresh("a"), _fresh("e")
    return f"aggregate({arr}, 0D, ({a}, {e}) -> {a} + {e})"


def layer_norm(h: str, eps: float = LAYER_NORM_EPS) -> str:
    def with_v(v):
        def with_m(m):
            def with_s(s):
                e = _fresh("e")
                return f"transform({v}, {e} -> ({e} - {m}) / sqrt({s} + {d(eps)}))"

            a, e = _fresh("a"), _fresh("e")
            var = f"aggregate({v}, 0D, ({a}, {e}) -> {a} + ({e} - {m}) * ({e} - {m})) / size({v})"
            return let(var, with_s)

        return let(f"{vsum(v)} / size({v})", with_m)

    return let(f"cast({h} as array<double>)", with_v)


def digit_logits(h: str, bases, n_digits: int, offset: int = 0, normalize: bool = True) -> str:
    cb = codebook(bases)
    width = 2 * len(bases)

    def body(hv):
        rows = []
        for k in range(n_digits):
            base = width * (offset + k)
            logits = []
            for dg in range(DIGITS):
                logits.append("(" + " + ".join(f"{hv}[{base + m}] * {d(cb[m][dg])}" for m in range(width)) + ")")
            rows.append("array(" + ", ".join(logits) + ")")
        return "array(" + ", ".join(rows) + ")"

    src = layer_norm(h) if normalize else f"cast({h} as array<double>)"
    return let(src, body)


def argmax_first(arr: str, decimals: int = 9) -> str:
    e = _fresh("e")
    return let(f"transform({arr}, {e} -> round({e}, {decimals}))",
               lambda r: f"(array_position({r}, array_max({r})) - 1)")


def decode_logits(logits: str, n_digits: int, frac_len: int) -> str:
    r = _fresh("r")

    def body(ds):
        terms = " + ".join(f"cast({ds}[{k}] as bigint) * {10 ** k}" for k in range(n_digits))
        return f"({terms}) / {d(10 ** frac_len)}"

    return let(f"transform({logits}, {r} -> {argmax_first(r)})", body)


def logsumexp(arr: str) -> str:
    def body(mx):
        a, e = _fresh("a"), _fresh("e")
        return f"({mx} + ln(aggregate({arr}, 0D, ({a}, {e}) -> {a} + exp({e} - {mx}))))"

    return let(f"array_max({arr})", body)


def digit_ce(logits: str, digits: str, n_digits: int) -> str:
    """Mean over digits of logsumexp(l_k) - l_k[d_k]."""
    def body(p):
        parts = [f"({logsumexp(f'{p}.l[{k}]')} - {p}.l[{k}][cast({p}.d[{k}] as int)])" for k in range(n_digits)]
        return "(" + " + ".join(parts) + f") / {d(n_digits)}"

    return let(f"named_struct('l', {logits}, 'd', {digits})", body)


def periodic_features(x: str, periods, dim: int, shift: str | None = None, mask_zero: bool = True) -> str:
    if 2 * len(periods) > dim:
        raise ValueError(f"{len(periods)} periods need {2 * len(periods)} > dim={dim}")
    xs = f"(cast({x} as double))" if shift is None else f"(cast({x} as double) * pow(10D, {shift}))"
    feats = []
    for p in periods:
        w = 2 * math.pi / p
        feats += [f"cos({xs} * {d(w)})", f"sin({xs} * {d(w)})"]
    feats += ["0D"] * (dim - len(feats))
    vec = "array(" + ", ".join(feats) + ")"
    if not mask_zero:
        return vec
    return f"CASE WHEN {x} <> 0 THEN {vec} ELSE array_repeat(0D, {dim}) END"


TWO_63 = "9.223372036854775807E18D"


def to_bigint(expr: str) -> str:
    """A whole number as BIGINT; beyond BIGINT its last 18 digits."""
    return let(expr, lambda v: f"CASE WHEN abs({v}) < {TWO_63} THEN cast({v} as bigint) "
                               f"WHEN abs({v}) < double('Infinity') THEN cast(pmod({v}, 1E18D) as bigint) END")


def digits_of(v: str, n: int) -> str:
    """Digits of a BIGINT expression (bound once), least significant first."""
    def body(x):
        parts = [f"pmod({x}, 10)"] + [f"pmod(({x} - pmod({x}, {10 ** k})) div {10 ** k}, 10)" for k in range(1, n)]
        return f"CASE WHEN {x} IS NOT NULL THEN array({', '.join(parts)}) END"

    return let(v, body)


def digits_rounded(x: str, int_len: int, frac_len: int) -> str:
    return digits_of(to_bigint(f"rint(cast({x} as double) * {d(10 ** frac_len)})"), int_len + frac_len)


def digits_truncated(x: str, int_len: int, frac_len: int) -> str:
    return digits_of(to_bigint(f"(cast({x} as double) * {d(10 ** frac_len)})"), int_len + frac_len)
