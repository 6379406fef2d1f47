import tempfile

import __spark_entry__ as E
from numweave.config import NumberFormat
from numweave.streaming import numbers as ST


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"lang", "place", "digit", "n"}


def test_every_query_has_oracle():
    from numweave.plans import catalog

    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())
    assert len(catalog.QUERIES) >= 95


def test_queries_run_on_smallest_tables(spark):
    qs = E.queries()
    for name in ("explode_numbers", "eval_report", "decode_periodic", "gen_pairs_mul_stratified", "run_summary",
                 "collate_scatter", "split_positional"):
        assert qs[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_streaming_numbers(spark):
    src = "/root/testdata/sf0.001"
    out, ck = tempfile.mkdtemp(), tempfile.mkdtemp()
    stream = ST.read_corpus_stream(spark, src + "/documents*.parquet",
                                   "doc_id bigint, text string, lang string, source string, n_chars bigint")
    fmt = NumberFormat(int_len=5, frac_len=2, bases=(2.0, 5.0), dim=64)
    q = ST.start_parquet_sink(ST.stream_numbers(stream, ["doc_id"], "text", fmt), out + "/nums", ck)
    q.awaitTermination(120)
    got = spark.read.parquet(out + "/nums").count()
    want = E.queries()["explode_numbers"](spark, src).count()
    assert got == want
