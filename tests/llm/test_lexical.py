import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numweave.llm import lexical
from numweave.llm.queries import QUERIES

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("term", T.StringType()),
                    T.StructField("score", T.StringType()), T.StructField("node", T.StringType()), T.StructField("n", T.StringType())])
ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rank", T.StringType())])
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(d[0], terms(d[1])) for d in docs]
    n = sum(1 for _, t in held if t)
    total = sum(len(t) for _, t in held)
    out = []
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    for i, text, *_ in items:
        asked = {t for t in terms(text) if t in df}
        found = []
        for d, t in held:
            m = 50 + 50 * len(t) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x in asked if x in t)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def tables(spark, docs, items):
    return (spark.createDataFrame([(d, t, "a", "b", "c", "d") for d, t in docs], DOC).repartition(5),
            spark.createDataFrame([(i, t, "x") for i, t in items], ITEM))


def some(seed=1, n=400):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(4000)] + ["The", "Ünï", "of", "ÀB"] * 300
    docs = [(i, rng.choice([" ", "\n", "-", "!?"]).join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(5, "same id w1 w2"), (5, "same id w1 w2"), (None, docs[3][1]), (None, "The of"),
             (2000, None), (2001, ""), (2002, "!!! --"), (2003, "w1 " * 30000 + "rare9")]
    items = [(i, docs[i * 9 % n][1][:150]) for i in range(20)] + [(50, None), (51, ""), (52, "notthere"), (53, "THE of"), (54, "rare9"),
             (7, docs[7][1]), (7, docs[7][1]), (None, "w1 w2 of")]
    return docs, items


@pytest.mark.parametrize("k,size", [(5, 128), (50, 4)])
def test_equals_brute_force(spark, monkeypatch, k, size):
    monkeypatch.setattr(lexical, "BLOCK", size)
    monkeypatch.setattr(lexical, "SEEDS", 2)
    docs, items = some()
    assert got(lexical.search(*tables(spark, docs, items), k)) == brute(docs, items, k)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_CHARS", 1500)
    docs, items = some(2, 60)
    assert got(lexical.search(*tables(spark, docs, items), 3)) == brute(docs, items, 3)


def test_empty(spark):
    docs, items = tables(spark, [(1, "a b")], [(1, "a")])
    assert lexical.search(docs.where("false"), items).count() == 0
    assert lexical.search(docs, items.where("false")).count() == 0
    assert got(lexical.search(docs, items)) == brute([(1, "a b")], [(1, "a")], 50)


def test_blocks_are_skipped(spark):
    rng = random.Random(4)
    topics = [[f"t{t}x{i}" for i in range(40)] for t in range(12)]
    docs = [(i, " ".join(rng.choices(topics[i % 12], k=30) + ["of", "the"] + rng.choices(topics[(i + 1) % 12], k=2))) for i in range(3000)]
    items = [(t, " ".join(topics[t][:12])) for t in range(12)]
    df, it = tables(spark, docs, items)
    block = lexical.Items.of([r["item_id"] for r in it.collect()], [r["text"] for r in it.collect()])
    fwd = lexical.written(lexical.forward(df, block.vocabulary, "doc_id", "text"), "fwd")
    freq = np.zeros(len(block.vocabulary), np.int64)
    for r in fwd.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        freq[r["t"]] = r["count"]
    n, total = fwd.agg(F.count("node"), F.sum("n")).first()
    plan = lexical.Plan(block, n, total, freq)
    best = {}
    for r in brute(docs, items, 10):
        best[r[0]] = min(best.get(r[0], 1 << 62), r[3])
    plan.bound[:] = [best[i] for i in block.ids]
    plan.essential(np.full(len(freq), 10**6))
    index = lexical.written(lexical.blocks(lexical.postings(fwd, plan), plan.width, 32), "index")
    pairs = sum(len(plan.lists[r["term"]]) for r in index.select("term").collect())
    kept = sum(len(r["items"]) for r in lexical.surviving(index, plan).collect())
    assert 0 < kept < 0.8 * pairs
    top = index.select("term", F.size("nodes").alias("n"), F.explode(F.arrays_zip("top_coords", "top")).alias("p")).collect()
    assert all(r["n"] <= 32 for r in top)
    assert got(lexical.search(df, it, 10)) == brute(docs, items, 10)


def test_cells_round_trip():
    c, v = np.array([0, 5, (1 << 20) - 1]), np.array([1, 999_999, 0])
    for width in (5, 6):
        got_c, got_v = lexical.unpacked(lexical.packed(c, v, width).tobytes(), width)
        assert got_c.tolist() == c.tolist() and got_v.tolist() == v.tolist()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(QUERIES["op12_lexical_search"](spark, sf)) == brute(docs, items, 50)
