import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numweave.llm import merkle
from numweave.llm.queries import QUERIES

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                    T.StructField("g", T.StringType()), T.StructField("rank", T.StringType()), T.StructField("leaf", T.StringType())])


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, lang, source, n, text):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc, source, lang, n, text)])


def tree(nodes, fan):
    """(top digest, proof of each node as [(digit, siblings)])."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(proofs, at):
            run = nodes[i - i % fan:i - i % fan + fan]
            p.append((i % fan, run[:i % fan] + run[i % fan + 1:]))
        nodes = [h(*nodes[i:i + fan]) for i in range(0, len(nodes), fan)]
        at = [i // fan for i in at]
    return nodes[0], proofs


def brute(rows, fan=2):
    if not rows:
        return []
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    own, subs = {}, []
    for g in names:
        own[g] = sorted(((r, leaf(r[0], r[2], r[3], r[4], r[1])) for r in groups[g]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        subs.append(tree([x for _, x in own[g]], fan))
    root, over = tree([s for s, _ in subs], fan)
    out = []
    for g, (sub, proofs), top in zip(names, subs, over):
        for (r, x), p in zip(own[g], proofs):
            p = p + top
            cur = x
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                cur = leaf(r[0], r[2], r[3], r[4] + 1, r[1])
            for digit, sib in p:
                cur = h(*sib[:digit], cur, *sib[digit:])
            out.append((r[0], x, sub, root, h(*[s for _, sib in p for s in sib]), cur, cur == root))
    return sorted(out, key=str)


def audit(df, **kw):
    hit = F.pmod(F.crc32(df["doc_id"].cast("string").cast("binary")), F.lit(7)) == 0
    out = merkle.audit(df, hit, {"n_chars": df["n_chars"] + 1}, **kw)
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in out.collect()), key=str)


def some(n):
    langs = ["en", "é", None, "z", "en", "en"]
    rows = [(i, "x" * (i % 9) if i % 5 else None, langs[i % 6], f"s{i % 3}" if i % 4 else None, i if i % 11 else None, "a", "b", "c") for i in range(n)]
    return rows + [(None, "null id", "en", "s", 3, "", "", ""), (None, "", "en", "s", 3, "", "", ""), (7, "", "", "", 0, "", "", ""),
                   (7, "other", "en", "", 0, "", "", ""), *[(21, "same", "en", "s", 1, "", "", "")] * 9, (5000, "long " * 40000, "one", "s", 9, "", "", "")]


@pytest.mark.parametrize("n,fan,page", [(137, 2, 10), (150, 2, 2), (100, 3, 2)])
def test_equals_brute_force(spark, n, fan, page):
    rows = some(n)
    assert audit(spark.createDataFrame(rows, DOC).repartition(5), fan=fan, page=page) == brute(rows, fan)


def test_small_tables(spark):
    df = spark.createDataFrame(some(3), DOC)
    assert audit(df.where("false")) == []
    for rows in (some(0)[:1], [(1, "a", "en", "s", 1, "", "", "")], [(1, "a", "en", "s", 1, "", "", ""), (2, "a", "de", "s", 1, "", "", "")]):
        assert audit(spark.createDataFrame(rows, DOC)) == brute(rows)


def test_some_requests_and_a_damaged_record(spark):
    leaves = spark.range(300).select(F.col("id").alias("key"), F.lit("en").alias("group"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    m = merkle.manifest(leaves, "key", "group", 2, 3)
    assert len(m.groups.records) == 3
    out = merkle.proofs(m, m.leaves.where("key in (0, 5, 299)")).collect()
    top, want = tree([h(str(i)) for i in range(300)], 2)
    assert m.root == top
    assert {r["key"]: [(s["digit"], s["siblings"]) for s in r["proof"]] for r in out} == {k: want[k] for k in (0, 5, 299)}
    bad = m.groups.records[0].withColumn("children", F.transform("children", lambda c: F.when(c == h("5"), h("6")).otherwise(c)))
    m.groups.records[0] = bad
    with pytest.raises(Exception, match="does not match"):
        merkle.proofs(m, m.leaves.where("key = 5")).collect()
    assert len(merkle.proofs(m, m.leaves.where("key = 299")).collect()) == 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op13_merkle_manifest"](spark, sf)
    assert sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))
                   for r in got.collect()), key=str) == brute(rows)
