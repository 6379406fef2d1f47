"""DuckDB SQL fragments for the oracle queries.

The oracle is an independent formulation in DuckDB SQL; these helpers only
avoid retyping the same arithmetic (digits, hash order) in every statement.
DuckDB's ``//`` and ``%`` truncate, so floor/pmod are spelled out.
"""

from __future__ import annotations


def pmod(a: str, b: str) -> str:
    return f"((({a}) % ({b})) + ({b})) % ({b})"


def hash_order(seed, *cols) -> str:
    parts = ", ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"CAST(('0x' || substr(md5(concat_ws(':', {parts})), 1, 15)) AS BIGINT)"


def digit(v: str, k: int) -> str:
    p = 10 ** k
    return pmod(f"(({v}) - {pmod(v, str(p))}) // {p}", "10")


def digits_array(v: str, n: int) -> str:
    return "[" + ", ".join(digit(v, k) for k in range(n)) + "]"


def last_digits(v: str) -> str:
    """BIGINT of a whole DOUBLE; beyond BIGINT its last 18 digits."""
    return (f"CASE WHEN isfinite({v}) AND abs({v}) < 9223372036854775808.0 THEN TRY_CAST({v} AS BIGINT) WHEN isfinite({v}) "
            f"THEN CAST(fmod(fmod({v}, 1e18::DOUBLE) + 1e18::DOUBLE, 1e18::DOUBLE) AS BIGINT) END")


def scaled_rounded(x: str, frac_len: int) -> str:
    return last_digits(f"round_even(({x}) * {float(10 ** frac_len)!r}, 0)")


def scaled_truncated(x: str, frac_len: int) -> str:
    return last_digits(f"trunc(({x}) * {float(10 ** frac_len)!r})")


def digits_or_null(v: str, n: int) -> str:
    return f"CASE WHEN ({v}) IS NOT NULL THEN {digits_array(v, n)} END"


NUM_RE = r"(\d+\.?\d*)"
TOKEN_RE = r"(\[NUM\]|[\p{L}\d_]+|[^\p{L}\d_\s])"


def lit_list(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]"


def dbl(v: float) -> str:
    """Exact DOUBLE literal (Python repr round-trips)."""
    return f"{float(v)!r}::DOUBLE"


def dlist(values) -> str:
    return "[" + ", ".join(dbl(v) for v in values) + "]"


def periodic(x: str, periods, dim: int, shift: str | None = None) -> str:
    import math

    xs = f"({x})" if shift is None else f"(({x}) * pow(10.0, {shift}))"
    feats = []
    for p in periods:
        w = 2 * math.pi / p
        feats += [f"cos({xs} * {dbl(w)})", f"sin({xs} * {dbl(w)})"]
    feats += ["0.0::DOUBLE"] * (dim - len(feats))
    zeros = ", ".join(["0.0::DOUBLE"] * dim)
    return f"CASE WHEN ({x}) <> 0 THEN [{', '.join(feats)}] ELSE [{zeros}] END"


def layer_norm_cte(src: str, key: str, h: str = "h") -> str:
    """SELECT key, hn (normalised h) FROM src, two passes over the list."""
    return f"""SELECT * EXCLUDE (m, s), list_transform({h}, lambda e: (e - m) / sqrt(s + 1e-5)) AS hn FROM (
  SELECT *, list_reduce(list_prepend(0.0::DOUBLE, list_transform({h}, lambda e: (e - m) * (e - m))),
                        lambda a, b: a + b) / len({h}) AS s
  FROM (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, {h}), lambda a, b: a + b) / len({h}) AS m FROM ({src})))"""


def digit_logits(hn: str, bases, n_digits: int, offset: int = 0) -> str:
    from ..config import DIGITS, codebook

    cb = codebook(bases)
    width = 2 * len(bases)
    rows = []
    for k in range(n_digits):
        base = width * (offset + k)
        logits = []
        for d in range(DIGITS):
            terms = [f"{hn}[{base + m + 1}] * {dbl(cb[m][d])}" for m in range(width)]
            logits.append("(" + " + ".join(terms) + ")")
        rows.append("[" + ", ".join(logits) + "]")
    return "[" + ", ".join(rows) + "]"


def argmax(lst: str) -> str:
    r = f"list_transform({lst}, lambda e: round(e, 9))"
    return f"(list_position({r}, list_max({r})) - 1)"
