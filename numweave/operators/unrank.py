"""Numbers 0 .. capacity - 1 to distinct tuples, without draws.

``permuted`` is a keyed bijection of 0 .. n - 1, so distinct row numbers give
distinct tuple numbers; ``sorted_pair`` and ``sorted_triple`` turn a tuple
number into the sorted tuple it stands for (combinatorial number system). A
request for n tuples is n rows, never a set to remove repetitions from.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import hash_order
from ..functions.text import _let

ROUNDS = 4
MAX_WALK = 64              # steps after which a walk that is still outside is an error
LARGEST = 1 << 62          # most tuples that can be numbered


def div(a, b) -> Column:
    return F.call_function("div", a, b)


def sides(n: Column) -> tuple[Column, Column]:
    """A grid a x b of at least n cells, at most a - 1 more than n."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("bigint"), F.lit(1).cast("bigint"))
    return a, F.greatest(div(n + a - 1, a), F.lit(1).cast("bigint"))


def permuted(x: Column, n: Column, seed, *keys) -> Column:
    """Place of x under a bijection of 0 .. n - 1 that seed and keys choose.

    x is a cell of a grid; in turn, each coordinate is shifted by a hash of the
    other, which is undone by shifting back, so the rounds are a bijection of
    the grid. Results outside 0 .. n - 1 go through it again until they are
    inside (cycle walking: no two numbers can meet). A grid has at most
    sqrt(n) cells too many, so a second step is rare.
    """
    def with_sides(s):
        a, b = s["a"], s["b"]

        def shift(i):
            def one(u):
                low, high = F.pmod(u, a), div(u, a)
                if i % 2 == 0:
                    return F.pmod(low + F.pmod(hash_order(seed, *keys, F.lit(i), high), a), a) + a * high
                return low + a * F.pmod(high + F.pmod(hash_order(seed, *keys, F.lit(i), low), b), b)

            return one

        def grid(v):
            for i in range(ROUNDS):
                v = _let(v, shift(i))
            return v

        steps = F.sequence(F.lit(2), F.lit(MAX_WALK))
        walked = F.aggregate(steps, grid(x.cast("bigint")), lambda v, _: F.when(v < n, v).otherwise(grid(v)))
        return _let(walked, lambda v: F.when(v < n, v).otherwise(
            F.raise_error(F.lit("a number did not come back into its range: choose another seed")).cast("bigint")))

    a, b = sides(n)
    return _let(F.struct(a.alias("a"), b.alias("b")), with_sides)


def _pairs_below(h: Column) -> Column:
    """Pairs lo <= hi with hi < h: h * (h + 1) / 2, without overflow."""
    return div(h, F.lit(2)) * (h + 1) + F.when(F.pmod(h, F.lit(2)) == 1, div(h + 1, F.lit(2))).otherwise(F.lit(0))


def sorted_pair(t: Column) -> Column:
    """Struct lo, hi (lo <= hi) of pair number t: pairs ascend by hi, then lo."""
    def exact(h):                                       # the square root is off by one at most
        return h - (_pairs_below(h) > t).cast("bigint") + (_pairs_below(h + 1) <= t).cast("bigint")

    guess = F.floor(F.sqrt(t.cast("double") * 2.0 + 0.25) - 0.5).cast("bigint")
    return _let(_let(guess, exact), lambda h: F.struct((t - _pairs_below(h)).alias("lo"), h.alias("hi")))


def _triples_below(c: Column) -> Column:
    """Sorted triples with all members < c: c * (c + 1) * (c + 2) / 6."""
    return div(c * (c + 1) * (c + 2), F.lit(6))


def sorted_triple(t: Column) -> Column:
    """Struct x0 <= x1 <= x2 of triple number t: triples ascend by x2, x1, x0."""
    def exact(base):                                    # the cube root is off by less than two
        return base + sum(((_triples_below(base + j) <= t).cast("bigint") for j in range(1, 5)), F.lit(0).cast("bigint"))

    base = F.greatest(F.floor(F.cbrt(t.cast("double") * 6.0)).cast("bigint") - 3, F.lit(0).cast("bigint"))
    return _let(_let(base, exact), lambda c: _let(sorted_pair(t - _triples_below(c)),
                                                  lambda p: F.struct(p["lo"].alias("x0"), p["hi"].alias("x1"), c.alias("x2"))))


def capacity_of(k: int, max_value: int) -> int:
    """Sorted k-tuples (k = 2 or 3) of 0 .. max_value."""
    n = math.comb(max_value + k, k)
    if n > LARGEST or (k == 3 and max_value > 2_000_000):
        raise ValueError(f"{k}-tuples of 0 .. {max_value} are too many to number in 64 bits")
    return n
