import math
import random
import struct

from pyspark.sql import functions as F

from numweave.functions import text as T
from numweave.operators import text as X


def test_extract_numbers_traps(spark):
    df = spark.createDataFrame([("a3.x 1.2.3 -45 7.50",), ("",), ("0+5=",), ("3. and 1e5",)], "t string")
    got = [r.n for r in df.select(T.extract_numbers("t").alias("n")).collect()]
    assert got[0] == [3.0, 1.2, 3.0, 45.0, 7.5]
    assert got[1] == []
    assert got[2] == [0.0, 5.0]
    assert got[3] == [3.0, 1.0, 5.0]


def test_signed_option(spark):
    df = spark.createDataFrame([("-45 and 7",)], "t string")
    assert df.select(T.extract_numbers("t", signed=True)).first()[0] == [-45.0, 7.0]


def test_mask_and_tokenize(spark):
    df = spark.createDataFrame([("où été 12+7045=",)], "t string")
    r = X.tokenize_masked(df, "t").select(T.mask_numbers("t").alias("m"), "tokens").first()
    assert r.m == "où été  [NUM] + [NUM] ="
    assert r.tokens == ["où", "été", "[NUM]", "+", "[NUM]", "="]


def test_max_number_reads_all_columns(spark):
    df = spark.createDataFrame([("12+7045=", 7057)], "question string, label bigint")
    assert X.max_number(df).first()[0] == 7057.0


def test_py_float_str_matches_python(spark):
    random.seed(7)
    vals = [0.0, -0.0, 1.0, 0.1, 0.1 + 0.2, 12345678.0, 1e16, 1.5e-5, 1e-4, 7.057, 2.5, 1e22, 123456.789,
            float("nan"), float("inf"), float("-inf")]
    vals += [random.uniform(-1e6, 1e6) for _ in range(300)]
    vals += [random.uniform(-1, 1) * 10 ** random.randint(-10, 15) for _ in range(300)]
    vals += [struct.unpack("<d", struct.pack("<Q", random.getrandbits(64)))[0] for _ in range(20000)]         # any bit pattern
    vals += [math.ldexp(1.0, e) for e in range(-1074, 1024)] + [math.nextafter(math.ldexp(1.0, e), 0) for e in range(-1022, 1024)]
    vals += [float(c) * 5e-324 for c in range(1, 300)] + [float(f"{m}e{e}") for e in range(-323, 308, 7) for m in (1, 2, 9.5)]
    vals += [2e23, 1e23, 123456789012345680.0, 2e-3, 9999999.999999998, 1.7976931348623157e308]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for col in (T.py_float_str("x"), T.py_float_str(F.col("x") * 1.0)):
        out = [r.s for r in df.select(col.alias("s")).collect()]
        for v, s in zip(vals, out):
            assert s == str(v), (v, s)


def test_number_token_stats_readme_example(spark):
    df = spark.createDataFrame([(1, "12345.6789")], "k int, t string")
    nums = X.explode_numbers(df, ["k"], "t")
    r = X.number_token_stats(nums).first()
    assert (r.digit_tokens, r.chunk_tokens, r.single_tokens) == (10, 5, 1)


def test_serialize_tabular_last_column_is_label(spark):
    df = spark.createDataFrame([(1, "a", 2.5, None, 0)], "a int, b string, c double, d string, y int")
    r = X.serialize_tabular(df).first()
    assert r.question == "1, a, 2.5, None"
    assert r.label == 0


def test_vocab_and_ids(spark):
    df = spark.createDataFrame([(1, "b a a [NUM]"), (2, "a 3")], "k int, t string")
    tok = X.tokenize_masked(df, "t")
    vocab = X.vocab_build(tok.select(F.explode("tokens").alias("token")))
    v = {r.token: r.id for r in vocab.collect()}
    assert v["[PAD]"] == 0 and v["[NUM]"] == 1 and v["a"] == 2 and v["b"] == 3
    ids = {r.k: r.input_ids for r in X.encode_token_ids(tok, ["k"], "tokens", vocab).collect()}
    assert ids[1] == [3, 2, 2, 1] and ids[2] == [2, 1]


def test_concat_question_label(spark):
    df = spark.createDataFrame([("1+2=", 3.0), ("x", 1e16)], "question string, label double")
    assert [r.text for r in X.concat_question_label(df).collect()] == ["1+2= 3.0", "x 1e+16"]


def test_filter_numeric_string(spark):
    df = spark.createDataFrame([("12",), ("-1.5",), ("1e5",), ("3.",), ("x",)], "s string")
    assert [r.s for r in X.filter_numeric_string(df, "s").collect()] == ["12", "-1.5"]
    assert not math.isnan(0.0)


def test_token_ids_keep_every_document(spark, monkeypatch):
    from numweave.operators import text as X

    rows = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["zz"]), (5, ["c"])]
    df = spark.createDataFrame(rows, "k int, tokens array<string>")
    vocab = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "token string, id int")
    want = {1: [2, 3, 2], 2: [], 3: [], 4: [-1], 5: [4]}
    for head in (65_536, 3):                                        # the vocabulary in the head, or partly in the tail
        monkeypatch.setattr(X, "HEAD_VOCAB_IDS", head)
        assert {r.k: r.ids for r in X.encode_token_ids(df, ["k"], "tokens", vocab, out="ids").collect()} == want
    cut = {r.k: (r.ids, r.n_tokens) for r in X.encode_token_ids(df, ["k"], "tokens", vocab, out="ids", max_positions=2).collect()}
    assert cut[1] == ([2, 3], 3) and cut[3] == ([], 0)


def test_max_number_without_numbers_raises(spark):
    import pytest

    from numweave.operators import text as X

    df = spark.createDataFrame([("x", "no digits")], "g string, t string")
    with pytest.raises(Exception, match="no number"):
        X.max_number(df, ["g"], ["t"]).collect()


def test_token_ids_of_the_head_move_nothing(spark, monkeypatch):
    """Head tokens are looked up in the row's array: no exchange, no row per token; the tail is filled in."""
    from numweave.operators import text as X

    df = spark.createDataFrame([(1, ["a", None, "c", "zz", "a"]), (2, None)], "k int, tokens array<string>")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "token string, id int")
    ids = X.encode_token_ids(df, ["k"], "tokens", vocab, out="ids")
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert {r.k: r.ids for r in ids.collect()} == {1: [0, -1, 2, -1, 0], 2: []}
    monkeypatch.setattr(X, "HEAD_VOCAB_IDS", 2)                     # c and d in the tail
    assert {r.k: r.ids for r in X.encode_token_ids(df, ["k"], "tokens", vocab, out="ids").collect()} == {1: [0, -1, 2, -1, 0], 2: []}


def test_tokens_are_counted_where_they_are_made(spark):
    from numweave.operators import text as X

    df = spark.createDataFrame([(["b", "a", "b", "[NUM]"],), (None,), ([],), (["a", "b"],)], "tokens array<string>").repartition(2)
    counts = X.token_counts(df, "tokens")
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
    got = {r.token: (r.id, r.freq) for r in X.vocab_build(counts, count_col="n").collect()}
    assert got == {"[PAD]": (0, 0), "[NUM]": (1, 1), "b": (2, 3), "a": (3, 2)}
    assert got == {r.token: (r.id, r.freq) for r in X.vocab_build(df.select(F.explode("tokens").alias("token"))).collect()}
