"""Queries for vocabulary / token ids (2.4) and collation (2.6) over the
whole ``documents`` corpus: mask numbers, tokenize, build the vocabulary,
encode ids, index + batch, pad to the batch maximum (cut at 128), masks,
number scatter, last token, loss labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import IGNORE_INDEX, MAX_LENGTH, NUMBER_PATTERN
from ..functions import text as T
from ..operators import collate as C
from ..operators import text as X
from ..operators.split import index_by_hash
from . import sqlparts as S
from .registry import register, table

PAD_ID, NUM_ID = 0, 1
DOC_SEED = 71


def _docs_tok(spark, sf):
    """Tokenised afresh by whoever reads it: cheaper than a replicated copy of
    the tokenised corpus, and columns nobody asks for are pruned."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return X.tokenize_masked(d, "text").withColumn("numbers", T.extract_numbers("text")).drop("text")


def _vocab(tok):
    return X.vocab_build(X.token_counts(tok, "tokens"), count_col="n")


def _ids(spark, sf):
    """ids of the first MAX_LENGTH positions (the cut drops the rest), the
    full token count and the numbers that these positions can take, in one
    shuffle of one row per document."""
    tok = _docs_tok(spark, sf)
    return X.encode_token_ids(tok.withColumn("numbers", F.slice("numbers", 1, MAX_LENGTH)), ["doc_id"], "tokens", _vocab(tok), out="ids",
                              max_positions=MAX_LENGTH, carry=["numbers"])


def _batches(spark, sf):
    """doc_id, idx, batch_id: the index sees the key column only."""
    keys = table(spark, sf, "documents").select("doc_id")
    return C.collate_batch_id(index_by_hash(keys, ["doc_id"], seed=DOC_SEED))


def _collated(spark, sf):
    # ids come grouped by doc_id, the narrow index joins them there
    b = _ids(spark, sf).join(_batches(spark, sf), "doc_id")
    return C.collate_pad(b, "ids", PAD_ID, length_col="n_tokens")


_MASK_RE = NUMBER_PATTERN
DOC_SQL = f"""d AS (SELECT doc_id, n_chars, regexp_extract_all(regexp_replace(text, '{_MASK_RE}', ' [NUM] ', 'g'), '{S.TOKEN_RE}', 1) AS toks,
                  list_transform(regexp_extract_all(text, '{S.NUM_RE}', 1), lambda s: CAST(s AS DOUBLE)) AS nums
           FROM documents),
t AS (SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM d),
f AS (SELECT token, count(*) AS freq FROM t GROUP BY token),
v AS (SELECT '[PAD]' AS token, 0 AS id, coalesce((SELECT freq FROM f WHERE token = '[PAD]'), 0) AS freq
      UNION ALL SELECT '[NUM]', 1, coalesce((SELECT freq FROM f WHERE token = '[NUM]'), 0)
      UNION ALL SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token) + 1 AS INTEGER), freq
                FROM f WHERE token NOT IN ('[PAD]', '[NUM]')),
ids AS (SELECT d.doc_id, coalesce(list(CAST(v.id AS INTEGER) ORDER BY t.pos) FILTER (WHERE v.id IS NOT NULL), []) AS ids
        FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN v ON v.token = t.token GROUP BY d.doc_id),
b AS (SELECT doc_id, ids, nums, row_number() OVER (ORDER BY {S.hash_order(DOC_SEED, 'doc_id')}, doc_id) - 1 AS idx
      FROM ids JOIN d USING (doc_id)),
p AS (SELECT doc_id, idx, idx // 32 AS batch_id, nums,
             list_slice(list_concat(ids, list_resize([]::INTEGER[], bmax - len(ids), 0)), 1, {MAX_LENGTH}) AS input_ids
      FROM (SELECT *, max(len(ids)) OVER (PARTITION BY idx // 32) AS bmax FROM b))"""


@register("vocab_build", f"WITH {DOC_SQL} SELECT token, CAST(id AS INTEGER) AS id, CAST(freq AS BIGINT) AS freq FROM v")
def q_vocab_build(spark, sf):
    return _vocab(_docs_tok(spark, sf))


@register("encode_token_ids", f"""WITH {DOC_SQL}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids, md5(array_to_string(ids, ',')) AS ids_md5 FROM ids""")
def q_encode_token_ids(spark, sf):
    tok = _docs_tok(spark, sf)
    ids = X.encode_token_ids(tok, ["doc_id"], "tokens", _vocab(tok), out="ids")
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"),
                      F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@register("lookup_token_vectors", f"""WITH {DOC_SQL}
SELECT d.doc_id, count(t.pos) AS n_tokens, count(e.vec_id) AS n_found,
       round(sum(CAST(e.embedding[1] AS DOUBLE)), 6) AS first_sum
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN v ON v.token = t.token LEFT JOIN embeddings e ON e.vec_id = v.id
GROUP BY d.doc_id""")
def q_lookup_token_vectors(spark, sf):
    tok = _docs_tok(spark, sf)
    ids = X.encode_token_ids(tok, ["doc_id"], "tokens", _vocab(tok), out="ids").checkpoint()     # read for the counts and for the gather
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    vecs = X.lookup_token_vectors(ids, ["doc_id"], "ids", emb, "id", "embedding")
    return vecs.groupBy("doc_id").agg(
        F.count("pos").alias("n_tokens"), F.count("embedding").alias("n_found"),
        F.round(F.sum(F.col("embedding")[0].cast("double")), 6).alias("first_sum"))


@register("collate_batch_id", f"WITH {DOC_SQL} SELECT doc_id, CAST(idx AS BIGINT) AS idx, CAST(batch_id AS BIGINT) AS batch_id FROM p")
def q_collate_batch_id(spark, sf):
    return _batches(spark, sf).select("doc_id", "idx", "batch_id")


@register("collate_epoch_order", f"""
SELECT doc_id, CAST(idx AS BIGINT) AS idx, CAST(idx // 32 AS BIGINT) AS batch_id FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {S.hash_order(f"{DOC_SEED}:3", 'doc_id')}, doc_id) - 1 AS idx FROM documents)""")
def q_collate_epoch_order(spark, sf):
    return C.epoch_batches(table(spark, sf, "documents").select("doc_id"), ["doc_id"], DOC_SEED, 3)


@register("collate_pad", f"""WITH {DOC_SQL}
SELECT doc_id, CAST(batch_id AS BIGINT) AS batch_id, len(input_ids) AS padded_len,
       md5(array_to_string(input_ids, ',')) AS ids_md5 FROM p""")
def q_collate_pad(spark, sf):
    c = _collated(spark, sf)
    return c.select("doc_id", "batch_id", F.size("input_ids").cast("bigint").alias("padded_len"),
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


@register("collate_attention_mask", f"""WITH {DOC_SQL}
SELECT doc_id, CAST(list_sum(m) AS BIGINT) AS n_attended, md5(array_to_string(m, '')) AS mask_md5
FROM (SELECT doc_id, list_transform(input_ids, lambda t: CASE WHEN t <> {PAD_ID} THEN 1 ELSE 0 END) AS m FROM p)""")
def q_collate_attention_mask(spark, sf):
    c = C.collate_attention_mask(_collated(spark, sf), "input_ids", PAD_ID)
    m = F.col("attention_mask")
    return c.select("doc_id", F.aggregate(m, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_attended"),
                    F.md5(F.array_join(m, "")).alias("mask_md5"))


@register("collate_scatter", f"""WITH {DOC_SQL}
SELECT doc_id, CAST(len(list_filter(sc, lambda x: x <> 0)) AS BIGINT) AS n_filled,
       array_to_string(list_filter(list_transform(range(len(sc)), lambda i: CASE WHEN sc[i + 1] <> 0 THEN i END),
                                   lambda i: i IS NOT NULL), ',') AS positions,
       list_reduce(list_prepend(0.0::DOUBLE, sc), lambda a, b: a + b) AS value_sum
FROM (SELECT doc_id, list_transform(range(len(input_ids)), lambda i:
        CASE WHEN input_ids[i + 1] = {NUM_ID}
             THEN coalesce(nums[len(list_filter(input_ids[1:i + 1], lambda x: x = {NUM_ID}))], 0.0) ELSE 0.0 END) AS sc
      FROM p)""")
def q_collate_scatter(spark, sf):
    c = C.collate_scatter(_collated(spark, sf), "input_ids", "numbers", NUM_ID)
    sc = F.col("scatter")
    pos = F.filter(F.transform(sc, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    return c.select("doc_id", F.size(F.filter(sc, lambda x: x != 0)).cast("bigint").alias("n_filled"),
                    F.array_join(pos, ",").alias("positions"),
                    F.aggregate(sc, F.lit(0.0), lambda a, b: a + b).alias("value_sum"))


@register("collate_last_token", f"""WITH {DOC_SQL}
SELECT doc_id, CAST(len(list_filter(input_ids, lambda t: t <> {PAD_ID})) - 1 AS INTEGER) AS last_pos FROM p""")
def q_collate_last_token(spark, sf):
    return C.collate_last_token(_collated(spark, sf), "input_ids", PAD_ID).select("doc_id", "last_pos")


# Hidden states differ by position: state (doc, pos) is the embedding number (doc_id + pos) mod their count.
@register("pool_last_token", f"""WITH {DOC_SQL},
l AS (SELECT doc_id, CAST(len(list_filter(input_ids, lambda t: t <> {PAD_ID})) - 1 AS INTEGER) AS last_pos FROM p),
e AS (SELECT vec_id, embedding FROM embeddings)
SELECT doc_id, last_pos, CAST(i AS BIGINT) AS i, round(CAST(v AS DOUBLE), 9) AS v FROM (
  SELECT doc_id, last_pos, unnest(range(len(embedding))) AS i, unnest(embedding) AS v
  FROM l JOIN e ON last_pos >= 0 AND e.vec_id = (doc_id + last_pos) % (SELECT count(*) FROM embeddings))
UNION ALL SELECT doc_id, last_pos, NULL, NULL FROM l WHERE last_pos < 0""")
def q_pool_last_token(spark, sf):
    c = C.collate_last_token(_collated(spark, sf), "input_ids", PAD_ID).select("doc_id", "last_pos", F.size("input_ids").alias("n"))
    c = c.checkpoint()                                          # read for the states, for the picks and by the gather
    emb = table(spark, sf, "embeddings")
    count = emb.agg(F.count(F.lit(1))).scalar()
    states = (c.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest("n", F.lit(1)) - 1)).alias("pos"))
              .withColumn("vec_id", F.pmod(F.col("doc_id") + F.col("pos"), count)))
    pooled = C.pool_last_token_long(states, ["doc_id"], "pos", c.select("doc_id", "last_pos"),
                                    emb.select("vec_id", "embedding"), "vec_id", "embedding")
    return pooled.select("doc_id", "last_pos", F.posexplode_outer("embedding").alias("i", "v")).select(
        "doc_id", "last_pos", F.col("i").cast("bigint").alias("i"), F.round(F.col("v").cast("double"), 9).alias("v"))


# ---- plain-text method: question + ' ' + label text; loss only on the answer
REG_SQL = f"""r AS (SELECT doc_id, regexp_extract_all(text || ' ' || CAST(CAST(n_chars AS DOUBLE) AS VARCHAR), '{S.TOKEN_RE}', 1) AS toks,
                  CAST(len(regexp_extract_all(text, '{S.TOKEN_RE}', 1)) AS INTEGER) AS qlen FROM documents),
rt AS (SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM r),
rf AS (SELECT token, count(*) AS freq FROM rt GROUP BY token),
rv AS (SELECT '[PAD]' AS token, 0 AS id UNION ALL SELECT '[NUM]', 1
       UNION ALL SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token) + 1 AS INTEGER)
                 FROM rf WHERE token NOT IN ('[PAD]', '[NUM]')),
rids AS (SELECT r.doc_id, coalesce(list(CAST(rv.id AS INTEGER) ORDER BY rt.pos) FILTER (WHERE rv.id IS NOT NULL), []) AS ids
         FROM r LEFT JOIN rt ON rt.doc_id = r.doc_id LEFT JOIN rv ON rv.token = rt.token GROUP BY r.doc_id),
rb AS (SELECT doc_id, ids, qlen, (row_number() OVER (ORDER BY {S.hash_order(DOC_SEED, 'doc_id')}, doc_id) - 1) // 32 AS batch_id
       FROM rids JOIN r USING (doc_id)),
rp AS (SELECT doc_id, qlen, list_slice(list_concat(ids, list_resize([]::INTEGER[], bmax - len(ids), 0)), 1, {MAX_LENGTH}) AS input_ids
       FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS bmax FROM rb))"""


@register("collate_loss_labels", f"""WITH {REG_SQL}
SELECT doc_id, CAST(len(list_filter(lab, lambda x: x <> {IGNORE_INDEX})) AS BIGINT) AS n_loss_tokens,
       md5(array_to_string(lab, ',')) AS labels_md5
FROM (SELECT doc_id, list_transform(range(len(input_ids)), lambda i:
        CASE WHEN i >= qlen AND input_ids[i + 1] <> {PAD_ID} THEN input_ids[i + 1] ELSE {IGNORE_INDEX} END) AS lab FROM rp)""")
def q_collate_loss_labels(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    d = X.concat_question_label(d, "text", F.col("n_chars").cast("double"), out="full")
    d = X.question_len(d, "text", out="qlen").withColumn("tokens", T.tokenize("full"))
    vocab = _vocab(d)
    ids = X.encode_token_ids(d, ["doc_id"], "tokens", vocab, out="ids", max_positions=MAX_LENGTH, carry=["qlen"])
    ids = ids.join(_batches(spark, sf), "doc_id")
    c = C.collate_loss_labels(C.collate_pad(ids, "ids", PAD_ID, length_col="n_tokens"), "input_ids", "qlen", PAD_ID)
    lab = F.col("labels")
    return c.select("doc_id", F.size(F.filter(lab, lambda x: x != F.lit(IGNORE_INDEX))).cast("bigint").alias(
        "n_loss_tokens"), F.md5(F.array_join(lab, ",")).alias("labels_md5"))
