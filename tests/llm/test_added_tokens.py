import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from numweave.llm import tokens  # noqa: E402
from numweave.llm.queries import QUERIES  # noqa: E402

JSON = P.path("byte_bpe_50k.json")
TEXTS = ["<|endoftext|> a", "a<|endoftext|>", "<|endoftext|><|endoftext|>", "plain", "", None, "x <|endoftext|>\n\n<|endoftext|>y <|endoftext", "é <|endoftext|>'ll"]


def library_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in TEXTS]


def test_added_tokens_as_the_library_gives_them(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").coalesce(1)
    want = library_ids()
    assert want[0] == [50256, 257, 0]
    got = {r.doc_id: r.ids for r in tokens.encode_documents(docs, JSON, added=True).collect()}
    assert [got[i] for i in range(len(TEXTS))] == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sizes = {i: len(x) for i, x in enumerate(want)}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op5_orc_ids"](spark, str(tmp_path)).collect()} == sizes
    assert {r.doc_id: r.doc_tokens for r in QUERIES["op3_concat_cut"](spark, str(tmp_path)).collect()} == sizes
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()} == sizes
