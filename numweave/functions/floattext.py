"""Python's text of every double, as Spark SQL over integers.

The shortest decimal that reads back as the same double (the nearest to it, if
several are equally short) is found by integer arithmetic after the Schubfach
method: the double and the ends of its rounding interval are scaled by a
126-bit power of ten, odd last bits standing for what is cut off, and the
shortest multiple of a power of ten inside the interval is taken. Products are
made of 30-bit limbs, so they stay in BIGINT.
"""

from __future__ import annotations

from .sqlexpr import d, let

_LOW, _HIGH = -324, 292                     # powers of ten that scale doubles
_LIMB = (1 << 30) - 1


def _log2_pow10(e: int) -> int:
    return (e * 913124641741) >> 38         # floor of e * log2(10), for the exponents in use


def _scale(k: int) -> int:
    """10 ** -k in 126 bits, rounded up."""
    shift = _log2_pow10(-k) - 125
    num, den = (10 ** -k, 1) if k <= 0 else (1, 10 ** k)
    return (num // (den << shift) if shift >= 0 else (num << -shift) // den) + 1


_SCALES = "cast(split('" + ",".join(str(_scale(k) >> (30 * i) & _LIMB) for k in range(_LOW, _HIGH + 1) for i in range(5)) + "', ',') as array<bigint>)"

_HALVES = "cast(split('" + ",".join(repr(2.0 ** -e) for e in range(-1022, 1024)) + "', ',') as array<double>)"     # 2^-e, exact


def double_bits(a: str) -> str:
    """The bits of a positive finite double, by exact scaling to its exponent."""
    def packed(e, m):                       # log2 is off by one at most near a power of two
        low = f"({m} < 1D AND {e} > -1022)"
        return (f"(CASE WHEN {m} >= 2D THEN {e} + 1 WHEN {low} THEN {e} - 1 ELSE {e} END + 1022L) * {1 << 52}L"
                f" + cast(CASE WHEN {m} >= 2D THEN {m} / 2D WHEN {low} THEN {m} * 2D ELSE {m} END * {d(1 << 52)} as bigint)")

    return let(f"cast(greatest(least(floor(log2({a})), 1023L), -1022L) as int)",
               lambda e: let(f"{a} * {_HALVES}[{e} + 1022]", lambda m: packed(e, m)))


def _product(g: str, cp: str) -> str:
    """floor(scale * cp / 2^127), its last bit set if anything was cut off."""
    low, high = f"({cp} & {_LIMB}L)", f"shiftright({cp}, 30)"

    def with_2(t2):
        t3 = f"{g}[3] * {low} + {g}[2] * {high} + shiftright({t2}, 30)"

        def with_3(t3):
            t4 = f"{g}[4] * {low} + {g}[3] * {high} + shiftright({t3}, 30)"

            def with_4(t4):
                top = f"({g}[4] * {high} + shiftright({t4}, 30))"
                cut = f"(shiftright({t2} & {_LIMB}L, 4) <> 0 OR ({t3} & {_LIMB}L) <> 0 OR ({t4} & 127L) <> 0)"
                return f"((shiftleft({top}, 23) | shiftright({t4} & {_LIMB}L, 7)) | CASE WHEN {cut} THEN 1L ELSE 0L END)"

            return let(t4, with_4)

        return let(t3, with_3)

    t1 = f"{g}[1] * {low} + {g}[0] * {high} + shiftright({g}[0] * {low}, 30)"
    return let(f"{g}[2] * {low} + {g}[1] * {high} + shiftright({t1}, 30)", with_2)


def shortest(a: str) -> str:
    """Struct n, k of a positive finite double: n * 10^k is its shortest decimal
    (n may end in zeros)."""
    def chosen(v):                          # v: lower, value, upper, odd, k; four times the scale of s
        def pick(s):
            near = (f"CASE WHEN ({v}.lower + {v}.odd <= 4 * {s}) <> (4 * ({s} + 1) + {v}.odd <= {v}.upper)"
                    f" THEN CASE WHEN {v}.lower + {v}.odd <= 4 * {s} THEN {s} ELSE {s} + 1 END"
                    f" WHEN {v}.value < 4 * {s} + 2 OR ({v}.value = 4 * {s} + 2 AND {s} % 2 = 0) THEN {s} ELSE {s} + 1 END")
            ten = f"({s} - {s} % 10)"
            below, above = f"({v}.lower + {v}.odd <= 4 * {ten})", f"(4 * ({ten} + 10) + {v}.odd <= {v}.upper)"
            return f"CASE WHEN {s} >= 10 AND {below} <> {above} THEN CASE WHEN {below} THEN {ten} ELSE {ten} + 10 END ELSE {near} END"

        return f"named_struct('n', {let(f'shiftright({v}.value, 2)', pick)}, 'k', {v}.k)"

    def scaled(p):                          # p: c, q, k, half (the interval is narrower below a power of two)
        up = f"cast({p}.q + shiftright(-{p}.k * 913124641741L, 38) + 2 as int)"
        limbs = f"slice({_SCALES}, cast(({p}.k - {_LOW}) * 5 + 1 as int), 5)"

        def ends(w):
            at = [_product(f"{w}.g", f"shiftleft(4 * {p}.c + {x}, {w}.up)") for x in (f"(CASE WHEN {p}.half THEN -1L ELSE -2L END)", "0L", "2L")]
            return f"named_struct('lower', {at[0]}, 'value', {at[1]}, 'upper', {at[2]}, 'odd', {p}.c % 2, 'k', {p}.k)"

        return let(let(f"named_struct('g', {limbs}, 'up', {up})", ends), chosen)

    def parts(b):
        big = f"({b} >= {1 << 52}L)"
        half = f"({b} % {1 << 52}L = 0 AND {b} > {1 << 52}L)"
        qq = f"(greatest({b} div {1 << 52}L, 1L) - 1075)"
        k = f"shiftright({qq} * 661971961083L - CASE WHEN {half} THEN 274743187321L ELSE 0L END, 41)"
        return let(f"named_struct('c', {b} % {1 << 52}L + CASE WHEN {big} THEN {1 << 52}L ELSE 0L END, 'q', {qq}, 'k', {k}, 'half', {half})", scaled)

    return let(double_bits(a), parts)


def _layout(p: str) -> str:
    """Digits p.d (no trailing zeros) and decimal exponent p.e in Python's way:
    fixed point for exponents in [-4, 16), else d.ddde+XX."""
    dg, e = f"{p}.d", f"{p}.e"
    n, ae = f"length({dg})", f"cast(abs({e}) as string)"
    sci = (f"concat(substr({dg}, 1, 1), CASE WHEN {n} > 1 THEN concat('.', substr({dg}, 2, {n})) ELSE '' END, "
           f"CASE WHEN {e} < 0 THEN 'e-' ELSE 'e+' END, lpad({ae}, greatest(length({ae}), 2), '0'))")
    small = f"concat('0.', repeat('0', -{e} - 1), {dg})"
    large = (f"CASE WHEN {n} <= {e} + 1 THEN concat({dg}, repeat('0', {e} + 1 - {n}), '.0') "
             f"ELSE concat(substr({dg}, 1, {e} + 1), '.', substr({dg}, {e} + 2, {n})) END")
    return f"CASE WHEN {e} < -4 OR {e} >= 16 THEN {sci} WHEN {e} < 0 THEN {small} ELSE {large} END"


def py_float_str(x: str) -> str:
    """Python ``str(float)``; ``x`` should be a cheap expression (it is
    referenced in several branches).

    Spark's own text is laid out like Python's for 1e-3 <= |x| < 1e7, and a text
    of at most 15 digits is the shortest one there can be (no two such decimals
    are the same double); all others are worked out by ``shortest``.
    """
    a = f"abs({x})"

    def relaid(r):
        def digits(t):
            return let(f"named_struct('d', rtrim('0', {t}), 'e', cast(length({t}) - 1 + {r}.k as int))", _layout)

        return let(f"cast({r}.n as string)", digits)

    return (f"CASE WHEN {x} IS NULL THEN CAST(NULL AS STRING) WHEN isnan({x}) THEN 'nan' "
            f"WHEN {a} = double('Infinity') THEN CASE WHEN {x} > 0 THEN 'inf' ELSE '-inf' END "
            f"WHEN {a} = 0D OR ({a} >= 0.001D AND {a} < 10000000.0D AND length(cast({a} as string)) <= 16) THEN cast({x} as string) "
            f"ELSE concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, {let(shortest(a), relaid)}) END")
