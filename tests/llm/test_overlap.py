import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from numweave.llm import overlap
from numweave.llm.queries import QUERIES

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType()),
                    T.StructField("size", T.StringType()), T.StructField("root", T.StringType()), T.StructField("bucket", T.StringType())])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    s = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= 80 * (len(s[i]) + len(s[j]) - both):
                at[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append((k is None, k))
    return sorted(((k, len(s[i]), min(least[find(i)])[1]) for i, (k, _) in enumerate(rows)), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(k, t, "a", "b", "c", "d") for k, t in rows], DOC).repartition(5)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in overlap.classes(df).collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def some(seed=1):
    rng = random.Random(seed)
    lines = [[f"l{i}x{j}" for j in range(30)] for i in range(4)]
    rows = []
    for i in range(120):
        words = [f"v{rng.randrange(4000)}" for _ in range(rng.randint(1, 120))] + (lines[i % 4] if i % 3 else [])
        rows.append(words)
        for _ in range(rng.choice([0, 0, 1, 3])):
            rows.append(edited(rng, words, rng.randint(0, max(1, len(words) // 40))))
        if i % 10 == 0:
            chain = words
            for _ in range(6):
                chain = edited(rng, chain, 1)
                rows.append(chain)
    star = [f"s{j}" for j in range(200)]
    rows += [star] + [edited(rng, star, 4) for _ in range(60)]
    texts = [rng.choice([" ", "\n", "\t "]).join(w) for w in rows]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one two"), (5004, "ONE\ttwo"), (5005, "one two three"), (None, texts[3]),
                   (None, ""), (7, texts[9]), (7, texts[9]), (5006, "É a b c d e"), (5007, "é a b c d e"), (5008, "a b c d e f g"),
                   *[(6000 + i, "x x x x x x " * 9) for i in range(30)], (7000, " ".join(f"q{i}" for i in range(60000))),
                   (7001, " ".join(f"q{i}" for i in range(58000)))]


@pytest.mark.parametrize("tile,orders", [(2048, 4), (8, 1)])
def test_equals_brute_force(spark, monkeypatch, tile, orders):
    monkeypatch.setattr(overlap, "TILE", tile)
    monkeypatch.setattr(overlap, "ORDERS", orders)
    rows = some()
    assert got(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert got(spark, [(1, "a b c")])[0] == (1, 1, 1)
    df = spark.createDataFrame([(1, "a", "", "", "", "")], DOC)
    assert overlap.classes(df.where("false")).count() == 0
    assert got(spark, [(2, None), (1, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_tree_loses_no_pair_and_skips_some():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64) for _ in range(150)]
    held = []
    for b in base:
        held.append(b)
        for _ in range(rng.integers(0, 4)):
            c = b.copy()
            c[rng.random(len(c)) < 0.08] = rng.integers(0, 1 << 62)
            held.append(c)
    held = [np.unique(x) for x in held]
    own = np.repeat(np.arange(len(held)), [len(x) for x in held])
    fine = overlap.points(own, np.concatenate(held), len(held))
    point = overlap.coarse(fine)
    size = np.array([len(x) for x in held])
    root = np.arange(len(held))
    links = {(i, j) for i in range(len(held)) for j in range(i) if 9 * len(np.intersect1d(held[i], held[j])) >= 4 * (size[i] + size[j])}
    tree = overlap.Tree(point, size, root)
    found = [(max(a, b), min(a, b)) for p, q, _ in overlap.tree_pairs(tree, tree) for a, b in zip(p.tolist(), q.tolist())]
    assert len(found) == len(set(found)) and links <= set(found)
    left = overlap.tree_links(np.arange(len(held)), fine, size, root, np.zeros(len(held), int))
    left = {(max(a, b), min(a, b)) for p, q, _ in left for a, b in zip(p.tolist(), q.tolist())}
    assert links <= left and len(left) < 1.5 * len(links) + 20
    for i, j in list(links)[:50]:
        assert overlap.bound_of(fine[i], fine[j]) >= len(np.intersect1d(held[i], held[j]))
    half = len(held) // 2
    a, b = overlap.Tree(point[:half], size[:half], root[:half]), overlap.Tree(point[half:], size[half:], root[half:])
    over = {(int(y) + half, int(x)) for p, q, _ in overlap.tree_pairs(a, b) for x, y in zip(p, q)}
    assert {x for x in links if x[0] >= half > x[1]} <= over
    one = overlap.Tree(point, size, np.zeros(len(held), np.int64))
    assert not sum(len(p) for p, _, _ in overlap.tree_pairs(one, one))


def test_spanning_pairs_join_what_all_pairs_join():
    rng = np.random.default_rng(5)
    node = np.arange(100, 160)
    root = node.copy()
    root[:10] = 100
    a, b = rng.choice(node, 400), rng.choice(node, 400)
    p, q, s = overlap.spanning(a, b, rng.random(400), node, root)
    assert len(p) <= 50 and (np.diff(s) <= 0).all()

    def classes(x, y):
        at = dict(zip(node.tolist(), root.tolist()))
        for u, v in zip(x.tolist(), y.tolist()):
            old, new = at[u], at[v]
            at = {k: new if r == old else r for k, r in at.items()}
        return len(set(at.values()))

    assert classes(p, q) == classes(a, b)


def test_full_counts_bound_anything():
    x = overlap.points(np.zeros(200_000, np.int64), np.arange(200_000, dtype=np.uint64), 1)[0]
    assert len(x) == 1 << 18
    full = bytes([255]) * 256
    assert overlap.bound_of(full, full) > 1 << 24 and overlap.bound_of(full[:128], bytes([1]) * 128) == 128
    assert overlap.folded(bytes([255, 0] * 128), 128)[0] >= 1 << 24


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = QUERIES["op11_count_vector_join"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(rows)
