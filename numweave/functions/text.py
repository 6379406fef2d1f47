"""String column expressions: number extraction, masking, tokenizing, Python
float text. All are built-in Spark expressions (JVM side, whole-stage codegen
where Spark supports it); none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NUM_REPLACEMENT, NUMBER_PATTERN

# Word / punctuation split keeping "[NUM]" whole; \p{L} keeps accented words.
TOKEN_PATTERN = r"(\[NUM\]|[\p{L}\d_]+|[^\p{L}\d_\s])"
NUMERIC_TEXT = r"^-?\d+(\.\d+)?$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def number_strings(text, signed: bool = False) -> Column:
    """All matches of the number pattern, in order, as strings."""
    pattern = ("-?" if signed else "") + NUMBER_PATTERN
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(f"({pattern})"), 1)


def extract_numbers(text, signed: bool = False) -> Column:
    """ARRAY<DOUBLE> of every number in ``text`` (unsigned by default)."""
    return F.transform(number_strings(text, signed), lambda s: s.cast("double"))


def mask_numbers(text, signed: bool = False) -> Column:
    """Replace each number with `` [NUM] `` (spaces included)."""
    pattern = ("-?" if signed else "") + NUMBER_PATTERN
    return F.regexp_replace(_c(text), F.lit(pattern), F.lit(NUM_REPLACEMENT))


def tokenize(text) -> Column:
    """Word / punctuation tokens; ``[NUM]`` stays one token."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(TOKEN_PATTERN), 1)


def is_numeric_text(text) -> Column:
    return _c(text).rlike(NUMERIC_TEXT)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element
    ``transform``), so repeated references do not duplicate generated code."""
    return F.transform(F.array(value), body)[0]


def py_float_str_sql(expr: str) -> Column:
    """Python float text of a Spark SQL expression (parsed in one call)."""
    from .floattext import py_float_str as text_of

    return F.expr(text_of(f"({expr})"))


def py_float_str(x) -> Column:
    """Python ``str(float)`` of a DOUBLE column (name or Column)."""
    if isinstance(x, str):
        from .sqlexpr import q

        return py_float_str_sql(f"cast({q(x)} as double)")
    from .floattext import py_float_str as text_of

    return F.get(F.call_function("transform", F.array(_c(x).cast("double")), F.expr(f"x0 -> {text_of('x0')}")), F.lit(0))


def value_text(c, dtype: str) -> Column:
    """Python ``str()`` of a value of the given Spark simple type name."""
    if dtype in ("double", "float"):
        return py_float_str(c)
    if dtype == "boolean":
        return F.when(_c(c), F.lit("True")).otherwise(F.lit("False"))
    return _c(c).cast("string")
