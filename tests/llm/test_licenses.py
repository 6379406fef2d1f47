from pathlib import Path

import duckdb
from pyspark.sql import types as T

from numweave.llm import licenses as L
from numweave.llm.license_texts import TEXTS
from numweave.llm.queries import ORACLE, QUERIES

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("digest", T.StringType()), T.StructField("key", T.StringType())])


def test_whole_texts_in_any_spelling_and_layout(spark):
    title, body = TEXTS["MIT"]
    variants = [body, f"{title}\n\nCopyright (c) 2024 Some One\n\n{body}", body.upper(), body.replace("sublicense", "sublicense"),
                "  " + body.replace("\n", "\n\n   ").replace('"', "'"), f"© 2020-2024 A. Author. All rights reserved.\n{body}\n\nAll rights reserved."]
    docs = [(i, t) for i, t in enumerate(variants)]
    docs += [(20, TEXTS["Zlib"][1].replace("acknowledgment", "acknowledgement")), (21, body + " and more"), (22, None), (23, ""),
             (24, "Copyright 2020 X"), (25, "text\nreleased under the MIT LICENCE\nmore\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0"),
             (25, "other"), (None, "Licensed under CC BY-NC 4.0"), (26, "word " * 100_000)]
    df = spark.createDataFrame([(i, t, "d", "k") for i, t in docs + docs[-2:]], DOC)
    got = {}
    for r in L.scan(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(got[i][0].license_id == "MIT" for i in range(len(variants)))
    assert got[20][0].license_id == "Zlib" and got[21][0].license_id is None
    assert [got[i][0].digest for i in (22, 23, 24)] == [None] * 3
    a, b = sorted(got[25], key=lambda r: -r.n_notice_lines)
    assert a.notices == ["CC-BY-NC-4.0", "MIT"] and a.n_notice_lines == 3 and b.notices == [] and b.n_notice_lines == 0
    assert [(r.license_id, r.notices, r.n_notice_lines) for r in got[None]] == [("CC-BY-NC-4.0", ["CC-BY-NC-4.0"], 1)] * 2
    assert L.scan(df.where("false")).count() == 0


def test_long_texts():
    """The long licences, where this machine has their texts, in another layout."""
    known = dict(L.known_rows())
    found = 0
    for file, name in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0-only"), ("GPL-3", "GPL-3.0-only"), ("LGPL-2.1", "LGPL-2.1-only"),
                       ("LGPL-3", "LGPL-3.0-only"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        path = Path("/usr/share/common-licenses") / file
        if path.exists():
            text = path.read_text(encoding="utf-8", errors="replace")
            for t in (text, text.upper().replace("\n", "\n   "), "Copyright 2020 Some One\n" + text):
                assert known.get(L.digest(" ".join(L.canonical_lines(t)))) == name
            found += 1
    title, body = TEXTS["Unlicense"]
    assert known[L.digest(" ".join(L.canonical_lines(body.replace("https", "http"))))] == "Unlicense"
    assert len(L.LONG_TEXTS) >= 13 and found in (0, 7)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ["doc_id", "digest", "license_id", "notices", "n_notice_lines"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE['op7_license_digest']})").fetchall(), key=str)
    got = sorted((tuple(r[n] for n in names) for r in QUERIES["op7_license_digest"](spark, sf).collect()), key=str)
    assert got == want and any(r[4] for r in got)
