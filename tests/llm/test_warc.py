import base64
import hashlib

import pytest
from pyspark.sql import types as T

zstandard = pytest.importorskip("zstandard")

from numweave.llm import warc  # noqa: E402

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                     T.StructField("html", T.StringType()), T.StructField("sha1", T.StringType()),
                     T.StructField("payload", T.StringType())])


def digest(x):
    return base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()


def brute(rows):
    top = {}
    for i, _, h, *_ in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, u, h, *_ in rows:
        t = top.get(h or "")
        revisit = t is not None and i != t
        out.append((str(i), len((h or "").encode()), digest(h), "revisit" if revisit else "response", str(t if revisit else None)))
    return sorted(out)


def got(df):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_round_trip(spark, parts, monkeypatch):
    rows = [(i, f"http://h/{i}\r\nX: y", f"<p>é {i % 40} \r\n\r\n</p>" * (1 + i % 7), "s", "p") for i in range(300)]
    rows += [(1000, None, None, "", ""), (1001, "u", "", "", ""), (None, "u", "only null", "", ""),
             (None, "u", "<p>x</p>", "", ""), (7000, "u", "<p>x</p>", "", ""), (7000, "u", "<p>x</p>", "", ""),
             (9000, "u", "long " * 400_000, "", "")]
    df = spark.createDataFrame(rows, PAGE).repartition(parts)
    folder = warc.archive_folder(spark)
    manifest = warc.write(df, folder)
    back = warc.read(manifest, folder)
    assert got(back) == brute(rows)
    for r in back.where("record_type = 'response'").collect():
        assert digest(bytes(r.payload).decode()) == r.payload_digest
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)


def test_archives_begin_with_their_dictionary(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"<html><body>page number {i} of many</body></html>" * 5, "", "") for i in range(800)],
                               PAGE).coalesce(1)
    folder = str(tmp_path)
    paths = [r.path for r in warc.write(df, folder).collect()]
    for p in paths:
        raw = open(p, "rb").read()
        assert raw[:4] == (0x184D2A5D).to_bytes(4, "little")
        n = int.from_bytes(raw[4:8], "little")
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8:8 + n]))
        one = d.decompressobj()
        assert one.decompress(raw[8 + n:]).startswith(b"WARC/1.1\r\n") and one.unused_data
        params = zstandard.get_frame_parameters(raw[8 + n:])
        assert params.dict_id == zstandard.ZstdCompressionDict(raw[8:8 + n]).dict_id() != 0


def test_empty_table(spark):
    df = spark.createDataFrame([], PAGE)
    folder = warc.archive_folder(spark)
    assert warc.read(warc.write(df, folder), folder).count() == 0
