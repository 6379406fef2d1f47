import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numweave.llm import components as C
from numweave.llm import grouping, words
from numweave.llm import neardup as N
from numweave.llm.queries import QUERIES

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("key", T.StringType()), T.StructField("node", T.StringType()), T.StructField("th", T.StringType())])


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def overlap(a, b):
    x, y = bag(a), bag(b)
    if not x or not y:
        return float(bool(x) == bool(y))
    low = sum((x & y).values())
    return low / (sum(x.values()) + sum(y.values()) - low)


def roots(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_words_and_shingles():
    texts = [b"", b" a  bb\tccc\n", b"x", b"one two three four five six", b"bb a", b"\xc3\xa9\xe6\xbc\xa2 a"]
    h, n = words.word_hashes(texts)
    assert n.tolist() == [len(t.split()) for t in texts]
    flat = [w for t in texts for w in t.split()]
    assert len(set(h.tolist())) == len(set(flat)) and len({*zip(flat, h.tolist())}) == len(set(flat))
    s, k = words.shingle_hashes(h, n)
    assert k.tolist() == [0, 1, 1, 2, 1, 1] and len(set(s.tolist())) == 6


def test_signatures_estimate_the_multiset_overlap_without_bias():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    a, b = [], []
    for _ in range(400):
        x = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        y = list(x)
        for _ in range(rng.randint(0, 12)):
            y[rng.randrange(len(y))] = rng.choice(vocab)
        if rng.random() < 0.4:
            x = x + x[:rng.randint(5, len(x))] * rng.randint(1, 6)     # counts above one
        a.append(" ".join(x))
        b.append(" ".join(y))
    exact = np.array([overlap(x, y) for x, y in zip(a, b)])
    assert np.allclose(exact, [N.similarity(x, y) for x, y in zip(a, b)])
    own, s, c = N.multisets(a + b)
    sig = N.signatures(own, s, c, 800)
    diff = (sig[:400] == sig[400:]).mean(1) - exact
    spread = np.sqrt(exact * (1 - exact) / N.M)
    assert abs(diff.mean()) < 4 * np.sqrt((spread ** 2).sum()) / 400
    assert 0.8 < diff.std() / np.sqrt((spread ** 2).mean()) < 1.2
    again = N.signatures(*N.multisets(b[:3]), 3)                       # a text's signature does not depend on its neighbours
    assert np.array_equal(again, sig[400:403])


@pytest.mark.parametrize("small", [0, 10 ** 6])
@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape, small, monkeypatch):
    monkeypatch.setattr(C, "SMALL_EDGES", small)
    rng = random.Random(6)
    n = 200
    links = {"chain": [(i, i + 1) for i in range(99)] + [(150, 151)], "star": [(77, i) for i in range(100) if i != 77],
             "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(120)]}[shape]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = roots(n, links)
    touched = {i for a, b in links if a != b for i in (a, b)}
    assert got == {i: want[i] for i in touched}
    assert C.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_no_link_of_a_large_bucket_is_lost(spark, monkeypatch):
    """Numbers in one bucket, linked if they differ by at most 3: the hub sees few of them."""
    monkeypatch.setattr(grouping, "BLOCK", 7)
    rng = random.Random(8)
    values = sorted(rng.sample(range(400), 90))
    sketch = spark.createDataFrame([(v, bytearray(v.to_bytes(2, "big"))) for v in values], "node bigint, sketch binary")
    buckets = spark.createDataFrame([(1, v) for v in values] + [(2, v) for v in values[:3]] + [(3, values[0])], "bucket bigint, node bigint")

    def near(a, b):
        x, y = (m[:, 0].astype(int) * 256 + m[:, 1] for m in (a, b))
        return abs(x - y) <= 4

    def fetch(nodes):
        return nodes.withColumn("content", F.col("node").cast("string"))

    def across(contents):
        number = np.array([int(c) for c in contents])
        return (lambda x, others: abs(number[others] - number[x]) <= 4), (lambda x, y: abs(number[y] - number[x]) <= 3)

    links, groups = grouping.linked(buckets, sketch, near, 2, lambda p: p.where("b - a <= 3"), fetch, across)
    want = roots(400, [(a, b) for a in values for b in values if 0 < b - a <= 3])
    got = {r.node: r.root for r in groups.collect()}
    assert {v: got.get(v, v) for v in values} == {v: want[v] for v in values}
    assert all(0 < r.b - r.a <= 3 for r in links.collect())


def test_overlaps_of_a_block_are_exact():
    texts = [t or "" for t in fixture()]
    link, confirm = N.across(texts)
    assert confirm is None
    rng = random.Random(2)
    for _ in range(60):
        x, others = rng.randrange(len(texts)), np.array(rng.sample(range(len(texts)), 8))
        others = others[[bool(bag(texts[y])) for y in others]]
        if bag(texts[x]):
            assert link(x, others).tolist() == [overlap(texts[x], texts[y]) >= 0.8 for y in others]


def fixture():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 6))) for _ in range(2000)]

    def text(n):
        return [rng.choice(vocab) for _ in range(n)]

    docs = []
    shared = text(60)
    for g in range(12):                                                # families with a few changed words
        base = text(rng.randint(30, 300))
        for _ in range(rng.randint(1, 12)):
            y = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                y[rng.randrange(len(y))] = rng.choice(vocab)
            docs.append(" ".join(y))
    docs += [" ".join(shared + text(20 + i)) for i in range(40)]       # a common passage is not enough
    docs += [docs[0]] * 30 + [docs[0].upper(), "  " + docs[0].replace(" ", "\n")]
    docs += ["", None, " \n", "one two", "one two", "two one", "a", "spam " * 5000, "spam " * 4500, "spam " * 2000, " ".join(text(20000))]
    return docs


def brute_classes(docs):
    links = [(i, j) for i in range(len(docs)) for j in range(i) if overlap(docs[i], docs[j]) >= 0.8]
    return roots(len(docs), links)


def test_classes_equal_brute_force(spark):
    docs = fixture()
    df = spark.createDataFrame([(i, t, "k", "n", "t") for i, t in enumerate(docs)], DOC).repartition(4)
    rows, links = N.classes(df)
    want = brute_classes(docs)
    assert {r.doc_id: r.class_id for r in rows.collect()} == dict(enumerate(want))
    kept = N.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert links.count() > 0


def test_null_ids_repeats_and_empty(spark):
    a = "one two three four five six seven eight"
    rows = [(None, a), (4, a), (4, a), (2, a + " nine"), (None, "x"), (None, None), (7, "x"), (7, "other words"), (7, "x")]
    df = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], DOC)
    out, _ = N.classes(df)
    got = sorted((str(r.doc_id), str(r.class_id)) for r in out.collect())
    # the copies of a (overlap 0.8 with the longer one) and the x's; a null id stands only for a class without ids
    assert got == sorted([("None", "2"), ("4", "2"), ("4", "2"), ("2", "2"), ("None", "7"), ("None", "None"), ("7", "7"), ("7", "7"), ("7", "7")])
    kept = sorted((str(r.doc_id), str(r.text)) for r in N.deduplicated(df).collect())
    assert kept == sorted([("2", a + " nine"), ("7", "x"), ("7", "other words"), ("None", "None")])
    assert N.classes(df.where("false"))[0].count() == 0 and N.deduplicated(df.where("false")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want = brute_classes([t for _, t in docs])
    ids = [i for i, _ in docs]
    assert {r.doc_id: r.class_id for r in QUERIES["op10_bagminhash"](spark, sf).collect()} == {ids[i]: ids[w] for i, w in enumerate(want)}
