"""Question/label table generation (inventory 2.2) as DataFrame jobs.

The reference draws random operands until a Python set holds n unique pairs.
Here nothing is drawn twice: the rows of a table give the numbers 0 .. n - 1,
a keyed bijection turns them into tuple numbers, and tuple numbers are
unranked into sorted tuples (``unrank``). So exactly min(n, capacity) distinct
questions come out, sparse or dense, without a set, a shuffle that removes
repetitions, or chance. Product buckets are counted and unranked in the same
way. All sorted tuples are equally likely (drawing operands one by one and
sorting them gives tuples of equal operands half or a sixth of that weight).
Results are independent of partitioning and reruns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLASSIFY_COEFFS
from ..functions.numeric import hash_order
from ..functions.sqlexpr import d as sql_double
from ..functions.text import py_float_str_sql
from .order import smallest_by_hash
from .split import head_n, index_by_hash
from .unrank import _let, capacity_of, div, permuted, sorted_pair, sorted_triple


def gen_operands(df: DataFrame, key_cols, k: int, max_value: int, seed=0, prefix: str = "x") -> DataFrame:
    """Add k columns ``x0..x{k-1}`` uniform in [0, max_value] from a hash of the key."""
    keys = list(key_cols)
    out = df
    for i in range(k):
        out = out.withColumn(f"{prefix}{i}", F.pmod(hash_order(seed, *keys, F.lit(i)), F.lit(max_value + 1)))
    return out


def _canon(a: Column, b: Column):
    return F.least(a, b), F.greatest(a, b)


def pairs_add(df: DataFrame, a: str = "x0", b: str = "x1") -> DataFrame:
    lo, hi = _canon(F.col(a), F.col(b))
    return df.select(F.concat(lo.cast("string"), F.lit("+"), hi.cast("string"), F.lit("=")).alias("question"),
                     (lo + hi).cast("bigint").alias("label"))


def pairs_add_decimal(df: DataFrame, a: str = "x0", b: str = "x1", scale: float = 1000.0) -> DataFrame:
    lo, hi = _canon(F.col(a), F.col(b))
    s = sql_double(scale)
    lo_t = py_float_str_sql(f"least(`{a}`, `{b}`) / {s}")
    hi_t = py_float_str_sql(f"greatest(`{a}`, `{b}`) / {s}")
    return df.select(F.concat(lo_t, F.lit("+"), hi_t, F.lit("=")).alias("question"),
                     ((lo + hi) / F.lit(scale)).alias("label"))


def pairs_sub(df: DataFrame, a: str = "x0", b: str = "x1") -> DataFrame:
    lo, hi = _canon(F.col(a), F.col(b))
    return df.select(F.concat(hi.cast("string"), F.lit("-"), lo.cast("string"), F.lit("=")).alias("question"),
                     (hi - lo).cast("bigint").alias("label"))


def pairs_mul(df: DataFrame, a: str = "x0", b: str = "x1") -> DataFrame:
    lo, hi = _canon(F.col(a), F.col(b))
    return df.select(F.concat(lo.cast("string"), F.lit("*"), hi.cast("string"), F.lit("=")).alias("question"),
                     (lo * hi).cast("bigint").alias("label"))


def _sorted_triple(df: DataFrame, cols):
    return df.withColumn("_t", F.array_sort(F.array(*[F.col(c) for c in cols])))


def linear_score(t: Column, coeffs=CLASSIFY_COEFFS[:3]) -> Column:
    a, b, c = coeffs
    return (F.lit(float(a)) * t[0] + F.lit(float(b)) * t[1]) + F.lit(float(c)) * t[2]


def triples_label(df: DataFrame, cols=("x0", "x1", "x2"), coeffs=CLASSIFY_COEFFS, threshold=None) -> DataFrame:
    """Sorted triple ``"x,y,z"``; label 1 iff a*x + b*y + c*z - d > 0.
    ``threshold`` (Column or float) overrides d (balanced variant)."""
    d = threshold if threshold is not None else F.lit(float(coeffs[3]))
    if not isinstance(d, Column):
        d = F.lit(float(d))
    t = _sorted_triple(df, cols)
    score = linear_score(F.col("_t"), coeffs[:3]) - d
    return t.select(F.array_join(F.col("_t").cast("array<string>"), ",").alias("question"),
                    F.when(score > 0, 1).otherwise(0).cast("int").alias("label"))


def score_distribution(df: DataFrame, cols=("x0", "x1", "x2"), coeffs=CLASSIFY_COEFFS) -> DataFrame:
    """Linear score of sorted random triples; not deduplicated."""
    t = _sorted_triple(df, cols)
    return t.select(linear_score(F.col("_t"), coeffs[:3]).alias("score"))


def median_threshold(scores: DataFrame, col: str = "score") -> Column:
    """Exact interpolating median as a literal (see ``exact_median``)."""
    return exact_median(scores, col).select("d").scalar()


def order_key(v: Column) -> Column:
    """BIGINT that orders doubles as their values do: exponent and mantissa, the
    bits of the double, taken by exact arithmetic. -0.0 is 0.0; NaN is largest."""
    inf = F.lit(2047 << 52).cast("bigint")

    def scaled(a, e):                                   # a / 2^e, exact: factors are powers of two
        out = a
        for bit in range(10):
            on = F.getbit(F.abs(e).cast("bigint"), F.lit(bit)) == 1
            out = out * F.when(on & (e > 0), F.lit(2.0 ** -(1 << bit))).when(on, F.lit(2.0 ** (1 << bit))).otherwise(F.lit(1.0))
        return out

    def bits(a):
        guess = F.greatest(F.least(F.floor(F.log2(a)), F.lit(1023)), F.lit(-1022)).cast("int")
        return _let(F.struct(guess.alias("e"), scaled(a, guess).alias("m")), lambda g: _bits(g["e"], g["m"]))

    def _bits(e, m):                                    # log2 is off by one at most near a power of two
        up, down = m >= 2.0, (m < 1.0) & (e > -1022)
        e2 = F.when(up, e + 1).when(down, e - 1).otherwise(e)
        m2 = F.when(up, m / 2.0).when(down, m * 2.0).otherwise(m)
        return (e2 + 1022).cast("bigint") * F.lit(1 << 52) + (m2 * float(1 << 52)).cast("bigint")

    a = F.abs(v)
    size = F.when(a == 0, F.lit(0).cast("bigint")).when(a == float("inf"), inf).otherwise(bits(a))
    return F.when(F.isnan(v), inf + 1).when(v < 0, -size).otherwise(size)


DIGIT_BITS = 16


def exact_median(scores: DataFrame, col: str = "score") -> DataFrame:
    """One row: d, the mean of the middle values; null without values.

    Radix selection: values are counted once, then a histogram over 16 bits of
    the value's order at a time tells which digit holds the middle. No rows are
    ranked, and no step sees more than 2^16 rows of one group, wherever the
    values lie and however often one repeats.
    """
    v = F.col(col).cast("double")
    per = (scores.filter(F.col(col).isNotNull()).groupBy(F.when(v == 0, F.lit(0.0)).otherwise(v).alias("v"))
           .agg(F.count(F.lit(1)).alias("c")).withColumn("k", order_key(F.col("v"))).checkpoint())
    n = per.agg(F.sum("c")).first()[0] or 0
    spark = scores.sparkSession
    if not n:
        return spark.range(1).select(F.lit(None).cast("double").alias("d"))
    middles = sorted({(n - 1) // 2, n // 2})
    paths = [(per, {m: m for m in middles})]                                    # rows left, place of each middle among them
    upto = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        step = []
        for rest, places in paths:
            digit = F.shiftright("k", shift)                                    # this digit and all above it
            hist = rest.groupBy(digit.alias("p")).agg(F.sum("c").alias("c")).withColumn("upto", F.sum("c").over(upto))   # at most 2^16 rows
            hit = [(F.col("upto") > at) & (F.col("upto") - F.col("c") <= at) for at in places.values()]
            for r in hist.filter(hit[0] if len(hit) == 1 else hit[0] | hit[1]).collect():                                # one or two rows
                inside = {m: at - (r["upto"] - r["c"]) for m, at in places.items() if r["upto"] - r["c"] <= at < r["upto"]}
                step.append((rest.filter(digit == r["p"]), inside))
        paths = step
    found = {m: rest.first()["v"] for rest, places in paths for m in places}
    return spark.range(1).select(((F.lit(found[(n - 1) // 2]) + F.lit(found[n // 2])) / F.lit(2.0)).alias("d"))


def dedupe_questions(df: DataFrame) -> DataFrame:
    """Unique (question, label) rows (hash aggregate with partial merge)."""
    return df.dropDuplicates(["question", "label"])


def limit_n(df: DataFrame, n: int, seed=0) -> DataFrame:
    """Exactly n rows (or all, when fewer), chosen by hash order of the question."""
    h = df.withColumn("_h", hash_order(seed, "question"))
    return smallest_by_hash(h, "_h", n, tie_cols=["question", "label"]).drop("_h")


def numbered(df: DataFrame, key_cols, n: int, seed=0, out: str = "i") -> DataFrame:
    """One row for every number 0 .. n - 1, made of df's rows: the row at place
    p in hash order stands for p, p + rows, p + 2 * rows, ... A table without
    rows gives none."""
    keys = list(key_cols)
    src = df.select(*keys)
    rows = src.count()
    if n <= rows:
        return head_n(src, keys, n, seed, out).select(out)
    copies = -(-n // max(rows, 1))
    number = F.col("_p") + F.col("_copy") * F.lit(rows)
    return (index_by_hash(src, keys, seed, "_p").select("_p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))).alias("_copy"))
            .select(number.alias(out)).filter(F.col(out) < n))


def _generate(df, key_cols, k, max_value, n, seed, make):
    """Row numbers -> tuple numbers by a keyed bijection -> sorted tuples ->
    text: exactly min(n, capacity) distinct tuples, none drawn twice."""
    capacity = capacity_of(k, max_value)
    t = permuted(F.col("i"), F.lit(capacity).cast("bigint"), seed)
    numbers = numbered(df, key_cols, min(n, capacity), seed)
    unranked = _let(t, sorted_pair if k == 2 else sorted_triple)
    return make(numbers.select(F.inline(F.array(unranked))).toDF(*[f"x{i}" for i in range(k)]))     # a generator: computed once a row


def gen_pairs_add(df, key_cols, max_value: int, n: int, seed=0):
    return _generate(df, key_cols, 2, max_value, n, seed, pairs_add)


def gen_pairs_add_decimal(df, key_cols, max_value: int, n: int, seed=0):
    return _generate(df, key_cols, 2, max_value, n, seed, pairs_add_decimal)


def gen_pairs_sub(df, key_cols, max_value: int, n: int, seed=0):
    return _generate(df, key_cols, 2, max_value, n, seed, pairs_sub)


def gen_pairs_mul(df, key_cols, max_value: int, n: int, seed=0):
    return _generate(df, key_cols, 2, max_value, n, seed, pairs_mul)


def bucket_width(max_value: int, splits: int) -> int:
    return max(1, (max_value * max_value + 1) // splits)


def product_bucket(label: Column, max_value: int, splits: int) -> Column:
    return F.least(F.call_function("div", label, F.lit(bucket_width(max_value, splits))), F.lit(splits - 1)).cast("int")


CHUNK = 4096                # smaller factors whose ranges are summed together


def product_ranges(spark, max_value: int, splits: int) -> DataFrame:
    """For every smaller factor a and bucket it reaches: the larger factors
    first .. first + n - 1 whose products fall in, and begin, the number of the
    bucket's pairs with a smaller a; capacity, ranges: pairs and rows of the
    bucket. At most (max_value + 1) * splits rows."""
    width, top = bucket_width(max_value, splits), F.lit(max_value).cast("bigint")
    a = F.col("a")
    ends = [product_bucket(x, max_value, splits) for x in (a * a, a * top)]
    reached = spark.range(max_value + 1).select(F.col("id").alias("a")).select("a", F.explode(F.sequence(*ends)).alias("bucket"))
    low = F.col("bucket").cast("bigint") * F.lit(width)
    high = F.when(F.col("bucket") == splits - 1, top * top).otherwise(low + F.lit(width - 1))
    first = F.when(a == 0, F.lit(0).cast("bigint")).otherwise(F.greatest(a, div(low + a - 1, F.greatest(a, F.lit(1)))))
    last = F.when(a == 0, top).otherwise(F.least(top, div(high, F.greatest(a, F.lit(1)))))
    ranges = (reached.select("bucket", "a", first.alias("first"), (last - first + 1).alias("n")).filter("n > 0")
              .withColumn("chunk", div(a, F.lit(CHUNK))))
    sums = ranges.groupBy("bucket", "chunk").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("bucket")
    before = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)           # one row per chunk
    offsets = sums.select("bucket", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
                          F.sum("n").over(whole).alias("capacity"), F.sum("rows").over(whole).alias("ranges"))
    inside = Window.partitionBy("bucket", "chunk").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    return (ranges.join(offsets, ["bucket", "chunk"])
            .select("bucket", "a", "first", "n", (F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("begin"), "capacity", "ranges"))


def gen_pairs_mul_stratified(df, key_cols, max_value: int, n: int, splits: int = 10, seed=0) -> DataFrame:
    """Exactly min(n // splits, pairs of the bucket) distinct pairs per
    equal-width product bucket (the last one absorbs the remainder).
    ``shortfall``: by how much a row's bucket stays below its quota.

    The pairs of a bucket are counted and numbered (``product_ranges``), numbers
    are taken by a keyed bijection, and each number is looked up in the range
    that holds it: ranges are laid over blocks of a range's mean length, so a
    number meets about two of them.
    """
    quota = n // splits
    ranges = product_ranges(df.sparkSession, max_value, splits).checkpoint()
    buckets = ranges.groupBy("bucket").agg(F.first("capacity").alias("capacity"), F.first("ranges").alias("ranges"))
    block = F.greatest(div(F.col("capacity"), F.col("ranges")), F.lit(1).cast("bigint"))
    numbers = (numbered(df, key_cols, quota * splits, seed)
               .select(F.pmod("i", F.lit(splits)).cast("int").alias("bucket"), div(F.col("i"), F.lit(splits)).alias("i"))
               .join(F.broadcast(buckets), "bucket").filter(F.col("i") < F.col("capacity"))                  # one row per bucket
               .select("bucket", "capacity", F.explode(F.array(permuted(F.col("i"), F.col("capacity"), seed, F.col("bucket")))).alias("t"),
                       block.alias("size"))
               .withColumn("block", div(F.col("t"), F.col("size"))))
    laid = ranges.select("bucket", "a", "first", "n", "begin", F.explode(F.sequence(
        div(F.col("begin"), block), div(F.col("begin") + F.col("n") - 1, block))).alias("block"))
    b = F.col("first") + F.col("t") - F.col("begin")
    held = numbers.join(laid, ["bucket", "block"]).filter((F.col("t") >= F.col("begin")) & (F.col("t") < F.col("begin") + F.col("n")))
    return held.select(
        F.concat(F.col("a").cast("string"), F.lit("*"), b.cast("string"), F.lit("=")).alias("question"),
        (F.col("a") * b).alias("label"), "bucket", F.greatest(F.lit(quota) - F.col("capacity"), F.lit(0).cast("bigint")).alias("shortfall"))


def gen_triples_label(df, key_cols, max_value: int, n: int, seed=0, coeffs=CLASSIFY_COEFFS):
    return _generate(df, key_cols, 3, max_value, n, seed, lambda t: triples_label(t, coeffs=coeffs))


def gen_score_distribution(df, key_cols, max_value: int, seed=0, coeffs=CLASSIFY_COEFFS):
    ops = gen_operands(df.select(*key_cols), key_cols, 3, max_value, seed)
    return score_distribution(ops, coeffs=coeffs)


def gen_triples_label_balanced(df, key_cols, max_value: int, n: int, seed=0, dist_seed=1,
                               coeffs=CLASSIFY_COEFFS):
    """Two passes: the median score of an independent draw becomes d."""
    d = median_threshold(gen_score_distribution(df, key_cols, max_value, dist_seed, coeffs))
    return _generate(df, key_cols, 3, max_value, n, seed, lambda t: triples_label(t, coeffs=coeffs, threshold=d))
