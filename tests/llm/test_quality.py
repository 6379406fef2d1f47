import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numweave.llm import quality as Q
from numweave.llm import toxicity
from numweave.llm.queries import QUERIES

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("n_words", T.StringType()), T.StructField("rule", T.StringType())])


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\t\x0b\x0c\r", "\x85 \xa0 　 a", "a " * 8, "a " * 9, "a " * 300, "x\n" * 40, "é# *$ %&|<>\n" * 30,
           "same line here\n same line here\nsame line here\r\nsame line here", "w" * 100_000, "one two " * 50_000]
    for _ in range(300):
        vocab = [rng.choice("abcdé漢😀#!") * rng.randint(1, 4) for _ in range(rng.randint(1, 30))]
        out.append("".join(rng.choice(vocab) + rng.choice([" ", "\n", "  ", "\t", "\x1c", " "]) for _ in range(rng.randint(0, 120))))
    return out


def test_counts_equal_brute_force(spark):
    t = texts()
    df = spark.createDataFrame([(i, x, "", "") for i, x in enumerate(t)] + [(None, "a b", "", ""), (0, None, "", "")], DOC)
    rows = Q.judged(Q.measures(df), []).collect()
    assert len(rows) == len(t) + 2
    for r in rows:
        want = brute(t[r.doc_id]) if r.doc_id is not None else brute("a b")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not r.base_failed)
    assert Q.measures(df.where("false")).count() == 0


def test_learned_rules_find_planted_thresholds():
    rng = np.random.default_rng(1)
    n = 6000
    table = {k: rng.random(n) for k in ("a", "b", "c")}
    bad = (table["a"] > 0.8) | ((table["b"] <= 0.3) & (table["c"] > 0.6))
    rules = Q.learn(table, bad)
    got = np.zeros(n, bool)
    for r in rules:
        got |= Q.covers(r, table)
    assert rules and (got == bad).mean() > 0.97
    assert Q.learn(table, np.zeros(n, bool)) == [] == Q.learn({}, np.zeros(0, bool))


def test_conditional_expression_equals_the_rules(spark):
    t = texts()
    df = spark.createDataFrame([(i, x, "", "") for i, x in enumerate(t)], DOC)
    rules = [(Q.Condition("symbols_per_word", True, 0.5), Q.Condition("word_length", True, 2.0)),
             (Q.Condition("distinct_words", False, 0.2),)]
    measured = Q.measures(df)
    rows = measured.select("*", *(c.alias(f"p_{n}") for n, c in Q.properties().items()), Q.verdict(rules).alias("got")).collect()
    assert {r.got for r in rows} == {0, 1, 2}
    for r in rows:
        first = 1 if r.p_symbols_per_word > 0.5 and r.p_word_length > 2 else 2 if r.p_distinct_words <= 0.2 else 0
        assert r.got == first


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op8_decision_list"](spark, sf)
    for r in out.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(docs[r.doc_id])
        assert r.kept == (not r.base_failed and r.rule == 0)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = out.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")) & ~F.col("base_failed")).collect()
    assert len(held) > 80
    assert sum(r.kept != (r.quality == 1) for r in held) <= 0.05 * len(held)
