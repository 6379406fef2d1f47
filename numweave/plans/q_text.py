"""Queries for the string / number operators (inventory 2.4-2.5) over the
corpus tables, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import text as X
from . import sqlparts as S
from .registry import register, table

NUM_RE = S.NUM_RE
TOK_RE = S.TOKEN_RE


def _docs(spark, sf):
    return table(spark, sf, "documents")


# -- flagship: documents -> numbers -> rounded digits -> histogram per language
FLAG_INT, FLAG_FRAC = 16, 2


@register("digits_rounded", f"""
WITH nums AS (SELECT lang, unnest(regexp_extract_all(text, '{NUM_RE}', 1)) AS raw FROM documents),
sc AS (SELECT lang, {S.scaled_rounded("CAST(raw AS DOUBLE)", FLAG_FRAC)} AS v FROM nums),
dg AS (SELECT lang, unnest(range({FLAG_INT + FLAG_FRAC})) AS place,
              unnest({S.digits_array("v", FLAG_INT + FLAG_FRAC)}) AS digit
       FROM sc WHERE v IS NOT NULL)
SELECT lang, CAST(place AS BIGINT) AS place, CAST(digit AS BIGINT) AS digit, count(*) AS n
FROM dg GROUP BY lang, place, digit
""")
def q_digits_rounded(spark, sf):
    nums = X.explode_numbers(_docs(spark, sf), ["doc_id", "lang"], "text")
    d = nums.select("lang", F.posexplode(N.digits_rounded("value", FLAG_INT, FLAG_FRAC)).alias("place", "digit"))
    return d.groupBy("lang", F.col("place").cast("bigint").alias("place"),
                     F.col("digit").cast("bigint").alias("digit")).agg(F.count(F.lit(1)).alias("n"))


@register("extract_numbers", f"""
SELECT doc_id, CAST(len(nums) AS BIGINT) AS n_numbers, list_max(nums) AS max_number,
       round(list_reduce(list_prepend(0.0::DOUBLE, nums), lambda a, b: a + b), 6) AS sum_numbers,
       nums[1] AS first_number
FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '{NUM_RE}', 1), lambda s: CAST(s AS DOUBLE)) AS nums
      FROM documents)
""")
def q_extract_numbers(spark, sf):
    d = X.with_numbers(_docs(spark, sf), "text")
    nums = F.col("numbers")
    return d.select(
        "doc_id",
        F.size(nums).cast("bigint").alias("n_numbers"),
        F.array_max(nums).alias("max_number"),
        F.round(F.aggregate(nums, F.lit(0.0), lambda a, b: a + b), 6).alias("sum_numbers"),
        F.get(nums, 0).alias("first_number"),
    )


@register("mask_numbers", f"""
SELECT doc_id, md5(m) AS masked_md5, CAST(length(m) AS BIGINT) AS masked_len
FROM (SELECT doc_id, regexp_replace(text, '\\d+\\.?\\d*', ' [NUM] ', 'g') AS m FROM documents)
""")
def q_mask_numbers(spark, sf):
    d = X.with_masked(_docs(spark, sf), "text")
    return d.select("doc_id", F.md5("masked").alias("masked_md5"),
                    F.length("masked").cast("bigint").alias("masked_len"))


@register("explode_numbers", f"""
SELECT doc_id, CAST(pos AS BIGINT) AS pos, raw, CAST(raw AS DOUBLE) AS value
FROM (SELECT doc_id, unnest(range(len(arr))) AS pos, unnest(arr) AS raw
      FROM (SELECT doc_id, regexp_extract_all(text, '{NUM_RE}', 1) AS arr FROM documents))
""")
def q_explode_numbers(spark, sf):
    return X.explode_numbers(_docs(spark, sf), ["doc_id"], "text")


@register("max_number", f"""
SELECT c_mktsegment AS split, max(m) AS max_number
FROM (SELECT c_mktsegment,
             list_max(list_transform(regexp_extract_all(
                 concat_ws(' ', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR),
                           CAST(c_acctbal AS VARCHAR)), '{NUM_RE}', 1), lambda s: CAST(s AS DOUBLE))) AS m
      FROM customer)
GROUP BY c_mktsegment
""")
def q_max_number(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "split")
    return X.max_number(c, ["split"], ["c_custkey", "c_name", "c_nationkey", "c_acctbal"])


@register("number_token_stats", f"""
WITH nums AS (SELECT lang, unnest(regexp_extract_all(text, '{NUM_RE}', 1)) AS raw FROM documents)
SELECT lang, count(*) AS n_numbers, CAST(sum(length(raw)) AS BIGINT) AS digit_tokens,
       CAST(sum(ceil(length(regexp_extract(raw, '^(\\d+)', 1)) / 3)
                + CASE WHEN strpos(raw, '.') > 0 THEN 1 ELSE 0 END
                + ceil(length(regexp_extract(raw, '\\.(\\d*)$', 1)) / 3)) AS BIGINT) AS chunk_tokens,
       count(*) AS single_tokens
FROM nums GROUP BY lang
""")
def q_number_token_stats(spark, sf):
    nums = X.explode_numbers(_docs(spark, sf), ["lang"], "text")
    return X.number_token_stats(nums, ["lang"])


@register("tokenize_masked", f"""
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens,
       CAST(len(list_filter(toks, lambda t: t = '[NUM]')) AS BIGINT) AS n_num_tokens,
       md5(array_to_string(toks, chr(1))) AS tokens_md5
FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '\\d+\\.?\\d*', ' [NUM] ', 'g'), '{TOK_RE}', 1) AS toks
      FROM documents)
""")
def q_tokenize_masked(spark, sf):
    d = X.tokenize_masked(_docs(spark, sf), "text")
    toks = F.col("tokens")
    return d.select(
        "doc_id",
        F.size(toks).cast("bigint").alias("n_tokens"),
        F.size(F.filter(toks, lambda t: t == F.lit("[NUM]"))).cast("bigint").alias("n_num_tokens"),
        F.md5(F.array_join(toks, "\u0001")).alias("tokens_md5"),
    )


@register("question_len", f"""
SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(len(regexp_extract_all(text, '{TOK_RE}', 1)) AS INTEGER) AS question_len
FROM conversations
""")
def q_question_len(spark, sf):
    c = table(spark, sf, "conversations")
    return X.question_len(c, "text").select("conv_id", "turn", "question_len")


@register("py_float_str", """
SELECT 'orders' AS src, o_orderkey AS id, CAST(o_totalprice AS VARCHAR) AS text FROM orders
UNION ALL SELECT 'customer', c_custkey, CAST(c_acctbal AS VARCHAR) FROM customer
UNION ALL SELECT 'events', event_id, CAST(value AS VARCHAR) FROM events
UNION ALL SELECT 'events_scaled', event_id, CAST(value * 1000000.0 AS VARCHAR) FROM events
UNION ALL SELECT 'events_small', event_id, CAST(value / 100000.0 AS VARCHAR) FROM events
""")
def q_py_float_str(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("id"),
                                          T.py_float_str("o_totalprice").alias("text"))
    c = table(spark, sf, "customer").select(F.lit("customer").alias("src"), F.col("c_custkey").alias("id"),
                                            T.py_float_str("c_acctbal").alias("text"))
    ev = table(spark, sf, "events")
    e = ev.select(F.lit("events").alias("src"), F.col("event_id").alias("id"), T.py_float_str("value").alias("text"))
    e2 = ev.select(F.lit("events_scaled").alias("src"), F.col("event_id").alias("id"),
                   T.py_float_str_sql("value * 1000000.0D").alias("text"))
    e3 = ev.select(F.lit("events_small").alias("src"), F.col("event_id").alias("id"),
                   T.py_float_str_sql("value / 100000.0D").alias("text"))
    return o.unionByName(c).unionByName(e).unionByName(e2).unionByName(e3)


@register("truncate_float", """
SELECT o_orderkey, floor((o_totalprice / 7.0) * 1000000.0) / 1000000.0 AS truncated FROM orders
""")
def q_truncate_float(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", N.truncate_float(F.col("o_totalprice") / F.lit(7.0), 6).alias("truncated"))


TR_INT, TR_FRAC = 6, 2


@register("digits_truncated", f"""
SELECT o_orderkey, array_to_string({S.digits_or_null("v", TR_INT + TR_FRAC)}, '') AS digits
FROM (SELECT o_orderkey, {S.scaled_truncated("o_totalprice", TR_FRAC)} AS v FROM orders)
""")
def q_digits_truncated(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey",
                    F.array_join(N.digits_truncated("o_totalprice", TR_INT, TR_FRAC), "").alias("digits"))


@register("signed_log_scale", """
WITH m AS (SELECT max(abs(c_acctbal)) AS mx FROM customer)
SELECT c_custkey, round((5.0 / ln(1 + mx)) * ln(1 + abs(c_acctbal)) * sign(c_acctbal), 9) AS scaled
FROM customer, m
""")
def q_signed_log_scale(spark, sf):
    c = table(spark, sf, "customer")
    mx = c.agg(F.max(F.abs("c_acctbal"))).scalar()  # scalar subquery, evaluated once
    s = F.lit(5.0) / F.log(F.lit(1.0) + mx)
    return c.select("c_custkey", F.round(N.signed_log_scale("c_acctbal", s), 9).alias("scaled"))


@register("signed_log_unscale", """
WITH m AS (SELECT max(abs(c_acctbal)) AS mx FROM customer),
s AS (SELECT c_custkey, 5.0 / ln(1 + mx) AS f, (5.0 / ln(1 + mx)) * ln(1 + abs(c_acctbal)) * sign(c_acctbal) AS p
      FROM customer, m)
SELECT c_custkey, round((exp(abs(p) / f) - 1) * sign(p), 6) AS restored FROM s
""")
def q_signed_log_unscale(spark, sf):
    c = table(spark, sf, "customer")
    mx = c.agg(F.max(F.abs("c_acctbal"))).scalar()
    s = F.lit(5.0) / F.log(F.lit(1.0) + mx)
    scaled = c.select("c_custkey", s.alias("f"), N.signed_log_scale("c_acctbal", s).alias("p"))
    return scaled.select("c_custkey", F.round(N.signed_log_unscale("p", F.col("f")), 6).alias("restored"))


@register("filter_numeric_string", """
SELECT doc_id, CAST(pos AS BIGINT) AS pos, word FROM (
  SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word
  FROM (SELECT doc_id, string_split_regex(text, '\\s+') AS w FROM documents))
WHERE regexp_full_match(word, '-?\\d+(\\.\\d+)?')
""")
def q_filter_numeric_string(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "word"))
    return X.filter_numeric_string(d, "word").withColumn("pos", F.col("pos").cast("bigint"))


# ---- projections of QA / tabular rows (2.4) -----------------------------------

@register("project_qa", """
SELECT p_partkey, CAST(p_name AS VARCHAR) AS question, CAST(p_retailprice AS DOUBLE) AS label FROM part
""")
def q_project_qa(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("question"),
                                        F.col("p_retailprice").alias("label"))
    return X.project_qa(p)


@register("serialize_tabular", r"""
SELECT regexp_replace(regexp_replace(concat_ws(' ', coalesce(CAST(c_custkey AS VARCHAR), 'None') || ',',
                                               coalesce(c_name, 'None') || ',',
                                               coalesce(CAST(c_nationkey AS VARCHAR), 'None') || ',',
                                               coalesce(CAST(c_acctbal AS VARCHAR), 'None') || ','), '^,+', ''),
                      ',+$', '') AS question,
       c_mktsegment AS label
FROM customer
""")
def q_serialize_tabular(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return X.serialize_tabular(c)


@register("concat_question_label", """
SELECT p_partkey, p_name || ' ' || CAST(p_retailprice AS VARCHAR) AS text FROM part
""")
def q_concat_question_label(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("question"),
                                        F.col("p_retailprice").alias("label"))
    return X.concat_question_label(p).select("p_partkey", "text")
