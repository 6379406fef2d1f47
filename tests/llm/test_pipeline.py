import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from numweave.llm import linededup, neardup, packing, quality, toxicity
from numweave.llm.scratch import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs, out = read_table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        res = stage(spark, docs, SF).cache()
        out.append((name, docs, res))
        docs = res
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(spark, stages):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "toxicity", "line_dedup", "near_dedup", "packing"]
    columns = read_table(spark, SF, "documents").columns
    for name, before, after in stages[:-1]:
        assert after.columns == columns and after.count() > 0


def test_filters_agree_with_their_operators(spark, stages):
    labels = read_table(spark, SF, "labels")
    _, docs, left = stages[0]
    measured = quality.measures(docs)
    judged = quality.judged(measured, quality.train(measured, labels))
    assert ids(left) == ids(judged.where("kept"))
    good = labels.where("quality = 1").join(judged.where("not base_failed"), "doc_id")
    assert good.where("not kept").count() <= 0.02 * good.count()         # clean documents stay
    _, docs, left = stages[1]
    assert ids(left) == ids(toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 0"))


def test_dedup_stages(spark, stages):
    _, docs, left = stages[2]
    assert ids(left) == ids(docs)
    seen = set()
    for r in sorted(left.collect()):
        for x in linededup.normalised_lines(r.text):
            assert not x or x not in seen
            seen.add(x)
        assert r.n_chars == len(r.text)
    _, docs, left = stages[3]
    heads = {r.class_id for r in neardup.classes(docs)[0].collect()}
    assert ids(left) == sorted(heads)


def test_packing_holds_every_kept_id(spark, stages):
    from tokenizers import Tokenizer

    _, docs, pieces = stages[4]
    t = Tokenizer.from_file(P.tokenizer_file("byte_bpe_50k.json"))
    want = {r.doc_id: t.encode(r.text, add_special_tokens=False).ids + [0] for r in docs.collect()}
    parts = {}
    for r in pieces.collect():
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())
        parts[r.doc_id] = parts.get(r.doc_id, 0) + r.length
    assert parts == {k: len(v) for k, v in want.items()}


def test_odd_rows_and_empty_table(spark):
    docs = read_table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, " \n ", None, "s", 3)], docs.schema)
    both = docs.unionByName(odd).withColumn("key", F.lit(1)).withColumn("kept", F.lit("x"))
    for rows in (both, both.where("false")):
        cur = rows
        for _, stage in P.STAGES[:-1]:
            cur = stage(spark, cur, SF)
            assert cur.columns == rows.columns
        assert cur.where("doc_id < 0 or doc_id is null").count() == 0
        assert P.pack(spark, cur, SF).count() >= 0
    line = P.line_dedup(spark, odd, SF).collect()
    assert sorted(str(r.text) for r in line) == ["", " \n ", "None"]
    assert P.near_dedup(spark, odd, SF).count() == 1                      # no words at all: one class
    assert packing.pieces(packing.stream(odd, P.tokenizer_file("byte_bpe_50k.json"))).count() == 3
