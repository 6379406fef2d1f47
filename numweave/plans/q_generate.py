"""Queries for dataset generation and splits (inventory 2.2-2.3). Operands
come from ``orders`` keys, so the work grows with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generate as G
from ..operators import split as P
from . import sqlparts as S
from .registry import register, table

KEY = "o_orderkey"


def _orders(spark, sf):
    return table(spark, sf, "orders")


def _ops_sql(seed, k, max_value):
    cols = ", ".join(f"{S.hash_order(seed, KEY, repr(str(i)))} % {max_value + 1} AS x{i}" for i in range(k))
    return f"SELECT {KEY}, {cols} FROM orders"


def _numbers_sql(seed, n):
    """The numbers 0 .. n - 1 from the rows of the table in hash order."""
    return f"""SELECT p + copy * n AS i FROM (
    SELECT row_number() OVER (ORDER BY {S.hash_order(seed, KEY)}, {KEY}) - 1 AS p, count(*) OVER () AS n FROM orders) o,
  (SELECT unnest(range(0, greatest(1, CAST(ceil({n} / CAST(count(*) AS DOUBLE)) AS BIGINT)))) AS copy FROM orders) WHERE p + copy * n < {n}"""


def _permuted_sql(src, seed, *keys):
    """src (i, n, other columns) and t, the place of i under the bijection."""
    def shift(part):
        return S.hash_order(seed, *keys, "r", part)

    def grid(v):
        return f"""list_reduce([{v}, 0, 1, 2, 3], lambda u, r: CASE WHEN r % 2 = 0
          THEN (u % a + {shift('(u // a)')} % a) % a + a * (u // a) ELSE u % a + a * ((u // a + {shift('(u % a)')} % b) % b) END)"""

    return f"""SELECT *, list_reduce(list_prepend({grid('i')}, range(2, 65)), lambda v, j: CASE WHEN v < n THEN v ELSE {grid('v')} END) AS t
  FROM (SELECT *, (n + a - 1) // a AS b FROM (SELECT *, CAST(ceil(sqrt(CAST(n AS DOUBLE))) AS BIGINT) AS a FROM ({src})))"""


def _tuple_numbers_sql(p, k):
    n = G.capacity_of(k, p["max_value"])
    return _permuted_sql(f"SELECT i, CAST({n} AS BIGINT) AS n FROM ({_numbers_sql(p['seed'], min(p['n'], n))})", p["seed"])


def _last_sql(t, below):
    """Largest h with below(h) <= t, searched bit by bit."""
    return f"list_reduce([0, {', '.join(str(1 << x) for x in range(30, -1, -1))}], lambda h, x: CASE WHEN {below('(h + x)')} <= {t} THEN h + x ELSE h END)"


def _pair_of_sql(t, rest):
    below = lambda h: f"(CAST({h} AS HUGEINT) * ({h} + 1)) // 2"
    return f"SELECT CAST({t} - {below('hi')} AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi{rest} FROM (SELECT *, {_last_sql(t, below)} AS hi FROM "


def _limit_sql(body, seed, n):
    return f"SELECT question, label FROM ({body}) p ORDER BY {S.hash_order(seed, 'question')}, question, label LIMIT {n}"


# parameters of the registered generators
ADD = dict(max_value=1_000_000, n=5000, seed=1)
DEC = dict(max_value=1_000_000, n=5000, seed=2)
SUB = dict(max_value=100_000, n=5000, seed=3)
MUL = dict(max_value=1000, n=5000, seed=4)
STRAT = dict(max_value=100, n=2000, splits=10, seed=5)
TRI = dict(max_value=1000, n=5000, seed=6)
OPS = dict(max_value=1000, seed=7)
DIST = dict(max_value=1000, seed=8)
DEDUPE_MAX = 30
LIMIT_N = 1000


@register("gen_operands", _ops_sql(OPS["seed"], 3, OPS["max_value"]))
def q_gen_operands(spark, sf):
    return G.gen_operands(_orders(spark, sf).select(KEY), [KEY], 3, OPS["max_value"], OPS["seed"])


def _pair_sql(p, sep, lo_first=True, label="lo + hi", text=lambda c: f"CAST({c} AS VARCHAR)", limit=None):
    """Generator oracle: pair numbers, the pair each stands for, the question text."""
    a, b = ("lo", "hi") if lo_first else ("hi", "lo")
    src = f"{_pair_of_sql('t', '')} ({_tuple_numbers_sql(p | {'n': limit or p['n']}, 2)}))"
    return f"SELECT {text(a)} || '{sep}' || {text(b)} || '=' AS question, {label} AS label FROM ({src})"


@register("gen_pairs_add", _pair_sql(ADD, "+", limit=ADD["n"]))
def q_gen_pairs_add(spark, sf):
    return G.gen_pairs_add(_orders(spark, sf), [KEY], ADD["max_value"], ADD["n"], ADD["seed"])


@register("gen_pairs_add_decimal", _pair_sql(DEC, "+", label="(lo + hi) / 1000.0",
                                             text=lambda c: f"CAST({c} / 1000.0 AS VARCHAR)", limit=DEC["n"]))
def q_gen_pairs_add_decimal(spark, sf):
    return G.gen_pairs_add_decimal(_orders(spark, sf), [KEY], DEC["max_value"], DEC["n"], DEC["seed"])


@register("gen_pairs_sub", _pair_sql(SUB, "-", lo_first=False, label="hi - lo", limit=SUB["n"]))
def q_gen_pairs_sub(spark, sf):
    return G.gen_pairs_sub(_orders(spark, sf), [KEY], SUB["max_value"], SUB["n"], SUB["seed"])


@register("gen_pairs_mul", _pair_sql(MUL, "*", label="lo * hi", limit=MUL["n"]))
def q_gen_pairs_mul(spark, sf):
    return G.gen_pairs_mul(_orders(spark, sf), [KEY], MUL["max_value"], MUL["n"], MUL["seed"])


_bsize = (STRAT["max_value"] ** 2 + 1) // STRAT["splits"]
_quota = STRAT["n"] // STRAT["splits"]


@register("gen_pairs_mul_stratified", f"""
WITH f AS (SELECT unnest(range(0, {STRAT['max_value'] + 1})) AS x),
every AS (SELECT a.x AS lo, b.x AS hi, least((a.x * b.x) // {_bsize}, {STRAT['splits'] - 1}) AS bucket FROM f a JOIN f b ON a.x <= b.x),
b AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY lo, hi) - 1 AS t, count(*) OVER (PARTITION BY bucket) AS n FROM every),
i AS (SELECT i // {STRAT['splits']} AS i, i % {STRAT['splits']} AS bucket FROM ({_numbers_sql(STRAT['seed'], _quota * STRAT['splits'])})),
w AS ({_permuted_sql("SELECT i, bucket, n FROM i JOIN (SELECT DISTINCT bucket, n FROM b) USING (bucket) WHERE i < n", STRAT['seed'], 'bucket')})
SELECT CAST(lo AS VARCHAR) || '*' || CAST(hi AS VARCHAR) || '=' AS question, lo * hi AS label,
       CAST(bucket AS INTEGER) AS bucket, greatest({_quota} - b.n, 0) AS shortfall FROM b JOIN w USING (bucket, t)
""")
def q_gen_pairs_mul_stratified(spark, sf):
    return G.gen_pairs_mul_stratified(_orders(spark, sf), [KEY], STRAT["max_value"], STRAT["n"],
                                      STRAT["splits"], STRAT["seed"])


def _triple_sql(seed, max_value, n, d_expr="10.0"):
    below = lambda c: f"(CAST({c} AS HUGEINT) * ({c} + 1) * ({c} + 2)) // 6"
    numbers = _tuple_numbers_sql(dict(seed=seed, max_value=max_value, n=n), 3)
    split = f"SELECT c, CAST(t - {below('c')} AS BIGINT) AS rest FROM (SELECT *, {_last_sql('t', below)} AS c FROM ({numbers}))"
    picked = f"SELECT lo AS a, hi AS b, CAST(c AS BIGINT) AS c FROM ({_pair_of_sql('rest', ', c')} ({split})))"
    return f"""SELECT concat_ws(',', a, b, c) AS question,
       CAST(CASE WHEN ((1.5::DOUBLE * a + -2.0::DOUBLE * b) + 0.5::DOUBLE * c) - {d_expr} > 0 THEN 1 ELSE 0 END AS INTEGER) AS label
FROM ({picked})"""


def _score_sql(seed, max_value):
    return f"""SELECT {KEY}, (1.5::DOUBLE * t[1] + -2.0::DOUBLE * t[2]) + 0.5::DOUBLE * t[3] AS score
FROM (SELECT {KEY}, list_sort([x0, x1, x2]) AS t FROM ({_ops_sql(seed, 3, max_value)}))"""


@register("gen_triples_label", _triple_sql(TRI["seed"], TRI["max_value"], TRI["n"]))
def q_gen_triples_label(spark, sf):
    return G.gen_triples_label(_orders(spark, sf), [KEY], TRI["max_value"], TRI["n"], TRI["seed"])


@register("gen_score_distribution", _score_sql(DIST["seed"], DIST["max_value"]))
def q_gen_score_distribution(spark, sf):
    o = _orders(spark, sf)
    ops = G.gen_operands(o.select(KEY), [KEY], 3, DIST["max_value"], DIST["seed"])
    t = ops.withColumn("_t", F.array_sort(F.array("x0", "x1", "x2")))
    return t.select(KEY, G.linear_score(F.col("_t")).alias("score"))


@register("agg_median_threshold", f"SELECT median(score) AS d FROM ({_score_sql(DIST['seed'], DIST['max_value'])})")
def q_agg_median_threshold(spark, sf):
    scores = G.gen_score_distribution(_orders(spark, sf), [KEY], DIST["max_value"], DIST["seed"])
    return G.exact_median(scores)


@register("gen_triples_label_balanced", _triple_sql(
    TRI["seed"], TRI["max_value"], TRI["n"],
    d_expr=f"(SELECT median(score) FROM ({_score_sql(DIST['seed'], DIST['max_value'])}))"))
def q_gen_triples_label_balanced(spark, sf):
    return G.gen_triples_label_balanced(_orders(spark, sf), [KEY], TRI["max_value"], TRI["n"], TRI["seed"],
                                        DIST["seed"])


@register("dedupe_questions", f"""
SELECT DISTINCT CAST(least(x0, x1) AS VARCHAR) || '*' || CAST(greatest(x0, x1) AS VARCHAR) || '=' AS question,
       x0 * x1 AS label FROM ({_ops_sql(9, 2, DEDUPE_MAX)})""")
def q_dedupe_questions(spark, sf):
    ops = G.gen_operands(_orders(spark, sf).select(KEY), [KEY], 2, DEDUPE_MAX, 9)
    return G.dedupe_questions(G.pairs_mul(ops))


@register("limit_n", _limit_sql(
    f"SELECT CAST(least(x0, x1) AS VARCHAR) || '+' || CAST(greatest(x0, x1) AS VARCHAR) || '=' AS question, "
    f"x0 + x1 AS label FROM ({_ops_sql(10, 2, 1_000_000)})", 10, LIMIT_N))
def q_limit_n(spark, sf):
    ops = G.gen_operands(_orders(spark, sf).select(KEY), [KEY], 2, 1_000_000, 10)
    return G.limit_n(G.pairs_add(ops), LIMIT_N, 10)


# ---- splits -----------------------------------------------------------------

def _index_sql(seed):
    return f"SELECT *, row_number() OVER (ORDER BY {S.hash_order(seed, KEY)}, {KEY}) - 1 AS idx FROM orders"


@register("split_positional", f"""
WITH i AS ({_index_sql(11)}), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM orders),
c AS (SELECT CAST(trunc(n * 0.8::DOUBLE * 0.9::DOUBLE) AS BIGINT) AS c1,
             CAST(trunc(n * 0.8::DOUBLE * 0.1::DOUBLE) AS BIGINT) AS c2 FROM n)
SELECT {KEY}, CAST(idx AS BIGINT) AS idx,
       CASE WHEN idx < c1 THEN 'train' WHEN idx < c1 + c2 THEN 'validation' ELSE 'test' END AS split
FROM i, c
""")
def q_split_positional(spark, sf):
    keys = _orders(spark, sf).select(KEY)
    return P.split_positional(P.index_by_hash(keys, [KEY], seed=11), base=keys)


@register("split_random", f"""
SELECT {KEY}, CASE WHEN CAST({S.hash_order(42, KEY)} AS DOUBLE) / {float(1 << 60)!r} < 0.1 THEN 'test' ELSE 'train' END AS split
FROM orders
""")
def q_split_random(spark, sf):
    return P.split_random(_orders(spark, sf).select(KEY), [KEY])


@register("head_n", f"SELECT {KEY}, CAST(idx AS BIGINT) AS idx FROM ({_index_sql(12)}) WHERE idx < 1000")
def q_head_n(spark, sf):
    return P.head_n(_orders(spark, sf).select(KEY), [KEY], 1000, seed=12)


@register("nested_prefixes", f"""
WITH i AS (SELECT o_totalprice AS v, idx FROM ({_index_sql(13)})),
n AS (SELECT count(*) AS n FROM orders),
sizes AS (SELECT CAST(0 AS BIGINT) AS size
          UNION ALL SELECT CAST(100 * pow(2, k) AS BIGINT) FROM range(0, 48) t(k), n WHERE 100 * pow(2, k) < n.n
          UNION ALL SELECT n FROM n)
SELECT size, count(v) AS n_rows, round(sum(v), 2) AS value_sum FROM sizes LEFT JOIN i ON i.idx < sizes.size
GROUP BY size
""")
def q_nested_prefixes(spark, sf):
    o = _orders(spark, sf).select(KEY, "o_totalprice")
    idx = P.index_by_hash(o, [KEY], seed=13)
    out = P.nested_prefixes(idx, "o_totalprice", base=o)
    return out.select("size", "n_rows", F.round("value_sum", 2).alias("value_sum"))
