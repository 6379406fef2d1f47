import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numweave.llm import toxicity as X

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("toxic", T.StringType()), T.StructField("key", T.StringType())])
LABEL = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType())])


def brute_evidence(counts, n, d=X.DISCOUNT):
    """Word evidence by textbook interpolated Kneser-Ney with shared lower orders."""
    def grams(w):
        p = X.BEFORE * (n - 1) + w + X.AFTER
        return [p[i:i + n] for i in range(len(p) - n + 1)]

    c = (Counter(), Counter())
    for w, per_class in counts.items():
        for k in (0, 1):
            if per_class[k]:
                for g in grams(w):
                    c[k][g] += per_class[k]
    seen = set(c[0]) | set(c[1])
    lower, cur = {}, seen
    for m in range(n - 1, 0, -1):
        lower[m] = Counter(g[1:] for g in cur)
        cur = set(lower[m])

    def shared(s):
        if not s:
            return 1 / (len(lower[1]) + 1)
        row = {g: v for g, v in lower[len(s)].items() if g[:-1] == s[:-1]}
        if not row:
            return shared(s[1:])
        t = sum(row.values())
        return max(row.get(s, 0) - d, 0) / t + d * len(row) / t * shared(s[1:])

    def prob(k, g):
        row = {x: v for x, v in c[k].items() if x[:-1] == g[:-1]}
        if not row:
            return shared(g[1:])
        t = sum(row.values())
        return max(row.get(g, 0) - d, 0) / t + d * len(row) / t * shared(g[1:])

    return lambda w: sum(math.log(prob(1, g) / prob(0, g)) for g in grams(w))


def test_evidence_equals_textbook_kneser_ney(spark):
    rng = random.Random(3)
    counts = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))): (rng.randint(0, 3), rng.randint(0, 2)) for _ in range(80)}
    counts = {w: c for w, c in counts.items() if sum(c)}
    words = spark.createDataFrame([(w, a, b) for w, (a, b) in counts.items()], "word string, ordinary bigint, toxic bigint")
    table = X.evidence(X.sequences(words, 4), 4).cache()
    rests = table.groupBy("h").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    model = X.Model(X._table(table, "g", "n", "value", 1 << 18), X._table(rests, "h", "n", "rest", 1 << 18), 4)
    want = brute_evidence(counts, 4)
    probes = [*counts, "zzz", "abzab", "a", "cccccccccc"]
    got = model.evidence(probes)
    for w, e in zip(probes, got):
        assert e == pytest.approx(want(w), abs=0.02), w          # cells hold 16-bit floats


def sample(n=600):
    rng = random.Random(5)
    plain = ["".join(rng.choice(["an", "the", "re", "on", "ti", "es"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    bad = ["grk" + w for w in plain]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        ws = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(4):
                ws[rng.randrange(len(ws))] = rng.choice(bad)
        docs.append((i, " ".join(ws), "x", "y"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = sample()
    docs += [(None, "the", "", ""), (9001, None, "", ""), (9002, "", "", ""), (9002, "", "", ""), (9003, "an " * 200_000, "", "")]
    d, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels + [(0, None), (None, 1)], LABEL)
    model = X.train(d, lab, cells=1 << 18, context_cells=1 << 18)
    rows = X.score(d, model).withColumn("held", X.held_out(F.col("doc_id"))).collect()
    assert len(rows) == len(docs)
    marks = dict(labels)
    held = [r for r in rows if r.held and r.doc_id in marks]
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    wrong = sum(r.predicted != marks[r.doc_id] for r in held)
    assert len(held) > 150 and wrong <= 0.03 * len(held)


def test_held_out_labels_change_nothing(spark):
    docs, labels = sample(300)
    d = spark.createDataFrame(docs, DOC)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (X.train(d, spark.createDataFrame(x, LABEL), cells=1 << 16, context_cells=1 << 16) for x in (labels, flipped))
    assert np.array_equal(a.cells, b.cells) and np.allclose(a.curve, b.curve)


def test_no_labels_of_a_class_and_empty_tables(spark):
    docs, labels = sample(60)
    d = spark.createDataFrame(docs, DOC)
    model = X.train(d, spark.createDataFrame([(i, 0) for i, _ in labels], LABEL))
    assert {(r.score, r.predicted) for r in X.score(d, model).collect()} == {(0.0, 0)}
    none = d.where("false")
    assert X.score(none, X.train(none, spark.createDataFrame([], LABEL))).count() == 0


def test_no_sequence_is_evicted(spark):
    """Far more sequences than cells: every one keeps its value."""
    rng = random.Random(9)
    words = {"".join(rng.choice("abcdefghij") for _ in range(6)): rng.randint(1, 50) for _ in range(500)}
    rows = spark.createDataFrame([(w, n, n / 64) for w, n in words.items()], "g string, n bigint, value double")
    table = X._table(rows, "g", "n", "value", 16)
    found, value = X.probe(table, X.letter_keys(X.letters("".join(words)).reshape(len(words), -1)))
    assert found.all() and value.tolist() == [n / 64 for n in words.values()]
    assert not X.probe(table, X.letter_keys(X.letters("zzzzzz").reshape(1, -1)))[0].any()


def test_counts_cover_every_training_document(spark):
    """A word that only one document has is known, whichever document it is."""
    docs, labels = sample(210)
    docs = [(i, f"{t} qv{chr(0x4E00 + i)}", a, b) for i, t, a, b in docs]
    model = X.train(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL), order=4)
    trained = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    grams = "".join(f"{X.BEFORE}qv{chr(0x4E00 + i)}" for i in trained)
    assert X.probe(model.cells, X.letter_keys(X.letters(grams).reshape(len(trained), -1)))[0].all()
