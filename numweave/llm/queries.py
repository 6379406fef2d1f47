"""The queries of this subpackage: (spark, sf_dir) -> DataFrame each."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from . import bpe, lexical, licenses, linededup, merkle, neardup, orcids, overlap, packing, quality, topk, toxicity, warc
from .scratch import read_table, shared_folder, small_batches, written

QUERIES: dict = {}
ORACLE: dict = {}


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def register(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        small_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@register
def op1_byte_bpe(spark, sf_dir):
    """Encode every text, decode the ids, and give a digest of both."""
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents"), path), path)
    return out.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op3_concat_cut(spark, sf_dir):
    """Pack all documents into windows of 1024 ids; one row per piece."""
    placed = packing.stream(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), added=True, packed=True)
    return packing.pieces(placed, 1024, with_ids=False)


@register
def op5_orc_ids(spark, sf_dir):
    """Write token ids as ORC in id order, read the files back."""
    path = shared_folder(spark, "orc-ids")
    orcids.write(read_table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), added=True)
    return orcids.checksums(orcids.read(spark, path))


@register
def op2_warc_zstd(spark, sf_dir):
    """Archive every page, read the archives back, one row per record."""
    folder = warc.archive_folder(spark)
    manifest = warc.write(read_table(spark, sf_dir, "pages"), folder)
    return warc.read(manifest, folder, with_payload=False).drop("url")


ORACLE["op2_warc_zstd"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
     r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '')
         AS payload_digest,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM r
""".strip()


@register
def op4_toxicity(spark, sf_dir):
    """Score every document; train on the labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register
def op8_decision_list(spark, sf_dir):
    """Measure every text, learn the rules from the labels, judge every text."""
    measured = written(quality.measures(read_table(spark, sf_dir, "documents")), "quality")
    rules = quality.train(measured, read_table(spark, sf_dir, "labels"), lambda k: ~toxicity.held_out(k))
    return quality.judged(measured, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@register
def op6_topk_inner(spark, sf_dir):
    """The five best other vectors of every 50th vector."""
    return topk.search(read_table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(50)) == 0, 5)


ORACLE["op6_topk_inner"] = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, q.r, c.r AS other, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS rank FROM s) WHERE rank <= 5
""".strip()


@register
def op10_bagminhash(spark, sf_dir):
    """Class of every document: texts linked by a multiset overlap of 0.8 or more."""
    rows, _ = neardup.classes(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "class_id")


@register
def op9_fuzzy_lines(spark, sf_dir):
    """Every document without the lines that another place already has."""
    out = linededup.deduplicated(read_table(spark, sf_dir, "documents"), counts="lines")
    return out.select("doc_id", "text", "lines.n_lines", "lines.n_removed")


@register
def op7_license_digest(spark, sf_dir):
    """Licence of every document by its canonical digest, and of its lines."""
    return (licenses.scan(read_table(spark, sf_dir, "documents"))
            .withColumn("notices", F.array_join("notices", " ")))


def _license_sql() -> str:
    """The same canonical form in SQL: one list of lines per document."""
    line = "regexp_replace(l, '[^\\p{L}\\p{N}]+', ' ', 'g')"
    line = f"' ' || replace(trim({line}), ' ', '  ') || ' '"
    for a, b in licenses.SPELLINGS.items():
        line = f"replace({line}, ' {a} ', ' {b} ')"
    line = f"trim(replace({line}, '  ', ' '))"
    rows = ", ".join(f"('{d}', '{n}')" for d, n in licenses.known_rows())
    return f"""
WITH known(digest, license_id) AS (VALUES {rows}),
     canon AS (SELECT doc_id, list_filter(list_transform(
                 string_split(lower(replace(coalesce(text, ''), '©', ' copyright ')), chr(10)), lambda l: {line}),
                 lambda x: x <> '' AND NOT regexp_matches(x, '{licenses.COPYRIGHT_LINE}')) AS c FROM documents),
     dig AS (SELECT doc_id, CASE WHEN len(c) > 0 THEN sha256(array_to_string(c, ' ')) END AS digest, c FROM canon),
     hit AS (SELECT d.doc_id, k.license_id FROM (SELECT doc_id, sha256(unnest(c)) AS ld FROM dig) d JOIN known k ON d.ld = k.digest)
SELECT dig.doc_id, dig.digest, k.license_id,
       coalesce((SELECT string_agg(DISTINCT license_id, ' ' ORDER BY license_id) FROM hit WHERE hit.doc_id = dig.doc_id), '') AS notices,
       (SELECT count(*) FROM hit WHERE hit.doc_id = dig.doc_id) AS n_notice_lines
FROM dig LEFT JOIN known k ON dig.digest = k.digest
""".strip()


ORACLE["op7_license_digest"] = _license_sql()


@register
def op13_merkle_manifest(spark, sf_dir):
    """Digest tree over all documents; every row checked against its root, some after a change of n_chars."""
    docs = read_table(spark, sf_dir, "documents")
    changed = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(7)) == 0
    return merkle.audit(docs, changed, {"n_chars": docs["n_chars"].cast("decimal(38,0)") + 1})


ORACLE["op13_merkle_manifest"] = """
WITH RECURSIVE
d AS (SELECT doc_id, source, lang, n_chars, text,
        CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
          || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS tail,
        (4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
            lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 7 = 0 AS hit
      FROM documents),
l AS (SELECT *, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
             sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS changed FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
t(g, k, i, n, h) AS (
  SELECT g, 0, i, n, leaf FROM r
  UNION ALL
  SELECT g, any_value(k) + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, i // 2),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(k, i, n, h) AS (
  SELECT 0, i, n, h FROM s
  UNION ALL
  SELECT any_value(k) + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY i // 2),
v AS (SELECT h AS root FROM u WHERE n = 1),
e AS (SELECT r.g, r.i AS id, t.k, (r.i >> t.k) & 1 AS odd, o.h AS other
      FROM r JOIN t ON t.g = r.g AND t.i = r.i >> t.k AND t.n > 1 LEFT JOIN t o ON o.g = t.g AND o.k = t.k AND o.i = xor(t.i, 1)
      UNION ALL
      SELECT r.g, r.i, 100 + u.k, (s.i >> u.k) & 1, o.h
      FROM r JOIN s ON s.g = r.g JOIN u ON u.i = s.i >> u.k AND u.n > 1 LEFT JOIN u o ON o.k = u.k AND o.i = xor(u.i, 1)),
p AS (SELECT g, id, sha256(coalesce(string_agg(other, '' ORDER BY k), '')) AS proof, count(other) AS m, list(odd ORDER BY k) AS odds, list(other ORDER BY k) AS others FROM e GROUP BY g, id),
f(g, id, k, h) AS (
  SELECT g, i, 1, CASE WHEN hit THEN changed ELSE leaf END FROM r
  UNION ALL
  SELECT f.g, f.id, f.k + 1, sha256(CASE WHEN odds[f.k] = 1 THEN others[f.k] || f.h ELSE f.h || coalesce(others[f.k], '') END)
  FROM f JOIN p ON p.g = f.g AND p.id = f.id WHERE f.k <= len(odds)),
w AS (SELECT g, id, arg_max(h, k) AS folded FROM f GROUP BY g, id)
SELECT r.doc_id, r.leaf, s.h AS subroot, v.root, coalesce(p.proof, sha256('')) AS proof_sha256, CAST(coalesce(p.m, 0) AS INTEGER) AS n_siblings,
       w.folded AS folded_root, w.folded = v.root AS verified
FROM r JOIN s ON s.g = r.g CROSS JOIN v JOIN w ON w.g = r.g AND w.id = r.i LEFT JOIN p ON p.g = r.g AND p.id = r.i
""".strip()


@register
def op12_lexical_search(spark, sf_dir):
    """The 50 best documents of every benchmark item."""
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 50)


ORACLE["op12_lexical_search"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
           FROM documents),
     c AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
     q AS (SELECT item_id, row_number() OVER () AS i, unnest(list_distinct(regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
           FROM benchmark),
     tf AS (SELECT doc_id, r, n, term, count(*) AS tf FROM (SELECT doc_id, r, len(w) AS n, unnest(w) AS term FROM d)
            WHERE term IN (SELECT term FROM q) GROUP BY ALL),
     wt AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, c GROUP BY term, nd),
     s AS (SELECT item_id, i, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l)))) AS BIGINT) AS score
           FROM q JOIN tf USING (term) JOIN wt USING (term), c GROUP BY item_id, i, doc_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0) WHERE rank <= 50
""".strip()


@register
def op11_count_vector_join(spark, sf_dir):
    """Component of every document: texts linked by a Jaccard overlap of 0.8 or more."""
    return overlap.classes(read_table(spark, sf_dir, "documents"))


ORACLE["op11_count_vector_join"] = r"""
WITH RECURSIVE
w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT r, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n
      HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(o.doc_id), s.doc_id)) AS component_id
FROM s LEFT JOIN c ON c.a = s.r LEFT JOIN s o ON o.r = c.b GROUP BY s.r, s.doc_id, s.s
""".strip()
