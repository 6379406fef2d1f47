"""Queries for encoders (2.7) and decoders / losses (2.8).

Numbers come from ``documents`` (explode_numbers); hidden states are the
64-dim ``embeddings`` vectors with their ``label`` as the target number.
Vectors are compared in long form (key, position, value rounded to 9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import NumberFormat
from ..functions import vector as V
from ..operators import decode as D
from ..operators import encode as E
from ..operators import text as X
from ..operators.split import index_by_hash
from . import sqlparts as S
from .registry import register, table

ENC = NumberFormat(int_len=5, frac_len=2, bases=(2.0, 5.0), dim=64)
DIG = NumberFormat(int_len=16, frac_len=2, bases=(10.0,), dim=64)
DEC = ENC
SHIFT_MAX, SHIFT_SEED = 2, 61
BATCH_SEED = 41
LIN_SEED, BIAS_SEED, HEAD_SEED = 31, 32, 51
W = V.rule_matrix(LIN_SEED, 64, 64)
B = V.rule_matrix(BIAS_SEED, 1, 64)[0]
HEAD_W = V.rule_matrix(HEAD_SEED, 1, 64)[0]
HEAD_B = 0.25


def _nums(spark, sf):
    return X.explode_numbers(table(spark, sf, "documents"), ["doc_id"], "text")


NUMS_SQL = f"""SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(raw AS DOUBLE) AS value FROM (
  SELECT doc_id, unnest(range(len(arr))) AS pos, unnest(arr) AS raw
  FROM (SELECT doc_id, regexp_extract_all(text, '{S.NUM_RE}', 1) AS arr FROM documents))"""


def _long(df, keys, vec="vector", decimals=9):
    return df.select(*keys, F.posexplode(vec).alias("i", "v")).select(
        *keys, F.col("i").cast("bigint").alias("i"), F.round("v", decimals).alias("v"))


def _long_sql(src, keys, vec, decimals=9):
    k = ", ".join(keys)
    return f"""SELECT {k}, CAST(i AS BIGINT) AS i, round(v, {decimals}) AS v FROM (
  SELECT {k}, unnest(range(len({vec}))) AS i, unnest({vec}) AS v FROM ({src}))"""


@register("encode_periodic", _long_sql(
    f"SELECT doc_id, pos, {S.periodic('value', ENC.periods, ENC.dim)} AS vec FROM ({NUMS_SQL})", ["doc_id", "pos"], "vec"))
def q_encode_periodic(spark, sf):
    return _long(E.encode_periodic(_nums(spark, sf), "value", ENC), ["doc_id", "pos"])


_g_sql = f"{S.hash_order(SHIFT_SEED, 'doc_id // 32')} % {SHIFT_MAX + 1}"


@register("encode_periodic_shift", _long_sql(
    f"SELECT doc_id, pos, {S.periodic('value', ENC.periods, ENC.dim, shift=_g_sql)} AS vec FROM ({NUMS_SQL})",
    ["doc_id", "pos"], "vec"))
def q_encode_periodic_shift(spark, sf):
    n = _nums(spark, sf).withColumn("batch_id", F.call_function("div", F.col("doc_id"), F.lit(32)))
    return _long(E.encode_periodic_shift(n, "value", ENC, "batch_id", SHIFT_MAX, SHIFT_SEED), ["doc_id", "pos"])


@register("encode_digits", f"""
SELECT doc_id, pos, array_to_string(list_transform(vec, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',') AS digits
FROM (SELECT doc_id, pos,
             CASE WHEN value <> 0 AND v IS NOT NULL THEN list_concat({S.digits_array('v', DIG.n_digits)}, list_resize([]::BIGINT[], {DIG.dim - DIG.n_digits}, 0))
                  WHEN value <> 0 THEN NULL
                  ELSE list_resize([]::BIGINT[], {DIG.dim}, 0) END AS vec
      FROM (SELECT doc_id, pos, value, {S.scaled_truncated('value', DIG.frac_len)} AS v FROM ({NUMS_SQL})))""")
def q_encode_digits(spark, sf):
    d = E.encode_digits(_nums(spark, sf), "value", DIG)
    return d.select("doc_id", "pos", F.array_join(F.transform("vector", lambda e: e.cast("bigint").cast("string")),
                                                  ",").alias("digits"))


EMB_SQL = f"""SELECT vec_id, CAST(label AS DOUBLE) AS label, CAST(embedding AS DOUBLE[]) AS h,
       (row_number() OVER (ORDER BY {S.hash_order(BATCH_SEED, 'vec_id')}, vec_id) - 1) // 32 AS batch_id
FROM embeddings"""


def _emb(spark, sf, batches: bool = False):
    """Vectors as doubles; batch ids (an index over all rows) only for the batch losses."""
    e = table(spark, sf, "embeddings")
    cols = ["vec_id", F.col("label").cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("h")]
    if not batches:
        return e.select(*cols)
    e = index_by_hash(e, ["vec_id"], seed=BATCH_SEED)
    return e.select(*cols, F.call_function("div", F.col("idx"), F.lit(32)).alias("batch_id"))


@register("layer_norm", _long_sql(S.layer_norm_cte(EMB_SQL, "vec_id"), ["vec_id"], "hn"))
def q_layer_norm(spark, sf):
    return _long(E.layer_norm(_emb(spark, sf), "h"), ["vec_id"])


@register("apply_linear", f"""
WITH w AS (SELECT unnest(range(64)) AS i, unnest([{', '.join(S.dlist(r) for r in W)}]) AS row,
                  unnest({S.dlist(B)}) AS b)
SELECT vec_id, CAST(i AS BIGINT) AS i, round(list_dot_product(h, row) + b, 9) AS v
FROM ({EMB_SQL}) e, w""")
def q_apply_linear(spark, sf):
    return _long(E.apply_linear(_emb(spark, sf), "h", W, B), ["vec_id"])


_LOG_S = "(5.0 / ln(1 + (SELECT max(label) FROM embeddings)))"


def _log_scale(spark, sf):
    mx = table(spark, sf, "embeddings").agg(F.max("label")).scalar()
    return F.lit(5.0) / F.log(F.lit(1.0) + mx)


@register("encode_logscale", _long_sql(f"""
SELECT vec_id, CASE WHEN s <> 0 THEN list_transform(h, lambda e: e * s) ELSE h END AS vec
FROM (SELECT vec_id, h, {_LOG_S} * ln(1 + abs(label)) * sign(label) AS s FROM ({EMB_SQL}))""", ["vec_id"], "vec"))
def q_encode_logscale(spark, sf):
    return _long(E.encode_logscale(_emb(spark, sf), "h", "label", _log_scale(spark, sf)), ["vec_id"])


@register("combine_additive", _long_sql(f"""
SELECT vec_id, list_transform(range(1, 65), lambda i: h[i] + p[i]) AS vec
FROM (SELECT vec_id, h, {S.periodic('label', ENC.periods, ENC.dim)} AS p FROM ({EMB_SQL}))""", ["vec_id"], "vec"))
def q_combine_additive(spark, sf):
    e = E.encode_periodic(_emb(spark, sf), "label", ENC, out="p")
    return _long(E.combine_additive(e, "h", "p"), ["vec_id"])


# ---- decoders ---------------------------------------------------------------

_LOGITS_SQL = f"SELECT vec_id, label, batch_id, {S.digit_logits('hn', DEC.bases, DEC.n_digits)} AS lg FROM ({S.layer_norm_cte(EMB_SQL, 'vec_id')})"


@register("digit_logits", f"""
SELECT vec_id, CAST(k AS BIGINT) AS k, CAST(d AS BIGINT) AS d, round(lg[k + 1][d + 1], 9) AS logit
FROM (SELECT vec_id, lg, unnest(range({DEC.n_digits})) AS k FROM ({_LOGITS_SQL})), range(10) t(d)""")
def q_digit_logits(spark, sf):
    d = D.digit_logits(_emb(spark, sf), "h", DEC)
    d = d.select("vec_id", F.posexplode("logits").alias("k", "row"))
    d = d.select("vec_id", "k", F.posexplode("row").alias("d", "logit"))
    return d.select("vec_id", F.col("k").cast("bigint").alias("k"), F.col("d").cast("bigint").alias("d"),
                    F.round("logit", 9).alias("logit"))


def _decode_sql_value():
    terms = " + ".join(f"CAST({S.argmax(f'lg[{k + 1}]')} AS BIGINT) * {10 ** k}" for k in range(DEC.n_digits))
    return f"({terms}) / {float(10 ** DEC.frac_len)!r}"


@register("decode_periodic", f"SELECT vec_id, {_decode_sql_value()} AS prediction FROM ({_LOGITS_SQL})")
def q_decode_periodic(spark, sf):
    return D.decode_periodic(_emb(spark, sf), "h", DEC).select("vec_id", "prediction")


def _ce_sql():
    """Cross-entropy terms over the logits lg and the digits of v."""
    parts = []
    for k in range(DEC.n_digits):
        lk = f"lg[{k + 1}]"
        lse = f"(list_max({lk}) + ln(list_reduce(list_prepend(0.0::DOUBLE, list_transform({lk}, lambda e: exp(e - list_max({lk})))), lambda a, b: a + b)))"
        parts.append(f"({lse} - {lk}[{S.digit('v', k)} + 1])")
    return "(" + " + ".join(parts) + f") / {float(DEC.n_digits)!r}"


@register("loss_digit_ce", f"""
SELECT batch_id, round(avg(ce), 9) AS loss FROM (
  SELECT batch_id, {_ce_sql()} AS ce FROM (SELECT *, {S.scaled_rounded('label', DEC.frac_len)} AS v FROM ({_LOGITS_SQL})))
GROUP BY batch_id""")
def q_loss_digit_ce(spark, sf):
    return D.loss_digit_ce(_emb(spark, sf, True), "h", "label", DEC).select("batch_id", F.round("loss", 9).alias("loss"))


_SHIFTED_SQL = f"SELECT vec_id, label, batch_id, {S.digit_logits('hn', DEC.bases, DEC.n_digits, 2)} AS lg FROM ({S.layer_norm_cte(EMB_SQL, 'vec_id')})"


@register("loss_digit_ce_shift", f"""
SELECT batch_id, round(avg(ce), 9) AS loss FROM (
  SELECT batch_id, {_ce_sql()} AS ce FROM (SELECT *, {S.scaled_rounded('label', DEC.frac_len)} AS v FROM ({_SHIFTED_SQL})))
GROUP BY batch_id""")
def q_loss_digit_ce_shift(spark, sf):
    """The digits sit two slices further up, as after a shift of two."""
    return D.loss_digit_ce(_emb(spark, sf, True), "h", "label", DEC, offset=2).select("batch_id", F.round("loss", 9).alias("loss"))


@register("decode_digits", f"""
SELECT vec_id, ({' + '.join(f"{S.pmod(f'CAST(round_even(h[{i + 1}], 0) AS BIGINT)', '10')} * {10 ** i}" for i in range(DEC.n_digits))})
       / {float(10 ** DEC.frac_len)!r} AS prediction
FROM ({EMB_SQL})""")
def q_decode_digits(spark, sf):
    return D.decode_digits(_emb(spark, sf), "h", DEC).select("vec_id", "prediction")


@register("loss_digit_rms", f"""
SELECT batch_id, round(sqrt(sum(sq) / (count(*) * {DEC.n_digits})), 9) AS loss FROM (
  SELECT batch_id, {' + '.join(f"pow(h[{i + 1}] - {S.digit('v', i)}, 2)" for i in range(DEC.n_digits))} AS sq
  FROM (SELECT *, {S.scaled_truncated('label', DEC.frac_len)} AS v FROM ({EMB_SQL})))
GROUP BY batch_id""")
def q_loss_digit_rms(spark, sf):
    return D.loss_digit_rms(_emb(spark, sf, True), "h", "label", DEC).select("batch_id", F.round("loss", 9).alias("loss"))


_HEAD_SQL = f"SELECT vec_id, label, batch_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, 65), lambda i: h[i] * {S.dlist(HEAD_W)}[i])), lambda a, b: a + b) + {S.dbl(HEAD_B)} AS head FROM ({EMB_SQL})"


def _head(spark, sf, batches: bool = False):
    return D.head_linear(_emb(spark, sf, batches), "h", HEAD_W, HEAD_B)


@register("head_linear", f"SELECT vec_id, round(head, 9) AS head FROM ({_HEAD_SQL})")
def q_head_linear(spark, sf):
    return _head(spark, sf).select("vec_id", F.round("head", 9).alias("head"))


@register("loss_log_mse", f"""
SELECT batch_id, round(avg(pow(head - {_LOG_S} * ln(1 + abs(label)) * sign(label), 2)), 9) AS loss
FROM ({_HEAD_SQL}) GROUP BY batch_id""")
def q_loss_log_mse(spark, sf):
    return D.loss_log_mse(_head(spark, sf, True), "head", "label", _log_scale(spark, sf)).select(
        "batch_id", F.round("loss", 9).alias("loss"))


@register("decode_logscale", f"""
SELECT vec_id, round((exp(abs(head) / {_LOG_S}) - 1) * sign(head), 9) AS prediction FROM ({_HEAD_SQL})""")
def q_decode_logscale(spark, sf):
    return D.decode_logscale(_head(spark, sf), "head", _log_scale(spark, sf)).select(
        "vec_id", F.round("prediction", 9).alias("prediction"))



@register("filter_nonzero_mask", f"""
SELECT doc_id, pos, value, round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(vec, lambda e: e * e)), lambda a, b: a + b), 9) AS sq_norm
FROM (SELECT doc_id, pos, value,
             CASE WHEN value <> 0 THEN vec ELSE list_transform(vec, lambda e: 0.0::DOUBLE) END AS vec
      FROM (SELECT doc_id, pos, value, {S.periodic('value', ENC.periods, ENC.dim).split(' THEN ', 1)[1].split(' ELSE ', 1)[0]} AS vec
            FROM ({NUMS_SQL})))""")
def q_filter_nonzero_mask(spark, sf):
    n = _nums(spark, sf).withColumn("vector", V.periodic_features("value", list(ENC.periods), ENC.dim, mask_zero=False))
    m = E.filter_nonzero_mask(n, "value", "vector")
    return m.select("doc_id", "pos", "value",
                    F.round(V.vsum(F.transform("vector", lambda e: e * e)), 9).alias("sq_norm"))
