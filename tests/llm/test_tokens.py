import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

P = pytest.importorskip("public_tokenizers")

from numweave.llm import bpe, orcids, packing  # noqa: E402
from numweave.llm.queries import QUERIES  # noqa: E402

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("ids", T.StringType()), T.StructField("key", T.StringType())])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    alpha = "ab sdmtlverx '  \n\t 　é9٣²!!''.-_漢😀́\x00\x1c "
    out = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return out + ["", None, "x" * 5000, "'" * 9 + "ll", "a'll've're's", "<|endoftext|> a", "word " * 30000, " \n", "dup", "dup"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Columns named like the operators' own are extra columns here."""
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOC).repartition(5)


def reference_ids(texts):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    return [enc.encode_ordinary(t or "") for t in texts]


def test_encode_equals_tiktoken_and_decodes(spark, docs, texts):
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()}
    assert len(got) == len(texts)
    for i, (t, ids) in enumerate(zip(texts, reference_ids(texts))):
        assert got[i].ids == ids, t
        assert bytes(got[i].decoded) == (t or "").encode()
        assert got[i].offsets[0] == 0 and got[i].offsets[-1] == len((t or "").encode())
        assert len(got[i].offsets) == len(ids) + 1


def test_slice_grouping_is_exact_on_mixing_collisions(monkeypatch):
    monkeypatch.setattr(bpe, "_ODD", np.array([0, 0], np.uint64))      # every short slice mixes to the same number
    raw = b"aabbaaccabcdefghijklmnopqrstuv" + b"abcdefghijklmnopqrstuv"
    cut = np.array([0, 2, 4, 6, 8, 30, 52])
    group, sample = bpe.distinct_slices(raw, cut)
    pieces = [raw[a:b] for a, b in zip(cut, cut[1:])]
    named = [raw[cut[s]:cut[s + 1]] for s in sample]
    assert [named[g] for g in group] == pieces


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_covers_the_stream(spark, docs, texts):
    want = library_ids(texts)
    placed = packing.stream(docs, JSON)
    rows = packing.pieces(placed, 1024).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        assert r.ids == want[r.doc_id][r.start:r.start + r.length] and r.length > 0
        assert r.ids_crc32 == crc(r.ids) and r.doc_tokens == len(want[r.doc_id])
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, ids in enumerate(want):
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert sum((p.ids for p in parts), []) == ids
    assert sorted(by_seq) == list(range(len(by_seq)))
    total = sum(map(len, want))
    for s, parts in by_seq.items():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at == (1024 if s < len(by_seq) - 1 else total - 1024 * s)
    whole = {r.sequence_id: r for r in packing.sequences(placed, 1024).collect()}
    assert sorted(whole) == sorted(by_seq)
    for s, parts in by_seq.items():
        ordered = sorted(parts, key=lambda r: r.offset)
        ids = sum((p.ids for p in ordered), [])
        assert whole[s].n_ids == len(ids) and whole[s].ids[:len(ids)] == ids
        assert len(whole[s].ids) == (len(ids) if len(ids).bit_count() == 1 else 1024)
        assert whole[s].doc_starts == [p.offset for p in ordered if p.start == 0]


def test_orc_round_trip(spark, docs, texts, tmp_path):
    path = f"file://{tmp_path}/ids"
    orcids.write(docs, path, JSON)
    want, at = library_ids(texts), 0
    rows = sorted(orcids.checksums(orcids.read(spark, path)).collect())
    for r, ids in zip(rows, want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert orcids.find(spark, path, [3, 4]).count() == 2
    plan = orcids.find(spark, path, [3])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in plan or "In(doc_id, [3])" in plan


def test_null_keys_repeats_and_empty_tables(spark, tmp_path):
    rows = [(None, "a b", "", ""), (None, None, "", ""), (5, "c", "", ""), (5, "c", "", "")]
    df = spark.createDataFrame(rows, DOC)
    orcids.write(df, f"file://{tmp_path}/n", JSON)
    got = orcids.checksums(orcids.read(spark, f"file://{tmp_path}/n")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 5, 5] and [r.start for r in got][2:] == [4, 6]
    assert packing.pieces(packing.stream(df, JSON)).count() == 4
    assert bpe.decode(bpe.encode(df, RANKS), RANKS).count() == 4
    none = df.where("false")
    orcids.write(none, f"file://{tmp_path}/e", JSON)
    placed = packing.stream(none, JSON)
    assert packing.pieces(placed).count() == packing.sequences(placed).count() == 0
    assert bpe.decode(bpe.encode(none, RANKS), RANKS).count() == 0


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op1_byte_bpe"](spark, sf).collect()}
    for (i, t), ids in zip(docs, reference_ids([t for _, t in docs]), strict=True):
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    want = library_ids([t for _, t in docs])
    at = 0
    for r, ids in zip(sorted(QUERIES["op5_orc_ids"](spark, sf).collect()), want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    for r in QUERIES["op3_concat_cut"](spark, sf).collect():
        assert r.ids_crc32 == crc(dict(zip((i for i, _ in docs), want))[r.doc_id][r.start:r.start + r.length])


def test_packed_ids_give_the_same_pieces(spark):
    from numweave.llm import tokens

    docs = spark.createDataFrame([(1, "some words " * 700), (2, None), (3, "ä€ 😀 x"), (4, ""), (5, "<|endoftext|> a" * 40)], "doc_id long, text string").repartition(3)
    rows = [sorted(map(tuple, packing.pieces(packing.stream(docs.coalesce(1).sortWithinPartitions("doc_id"), JSON, added=True, packed=p), 1024).collect()))
            for p in (False, True)]
    assert rows[0] == rows[1] and len(rows[0]) >= 5
    held = tokens.encode_documents(docs, JSON, added=True, packed=True).collect()
    assert all(len(r.ids) == 2 * r.n_tokens for r in held)          # two bytes an id, not an array element
