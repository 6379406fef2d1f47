"""Licence scan by canonical digests.

Lines are brought to a canonical form: lower case, everything but letters and
digits one blank, spellings that count as equal replaced. Blank and copyright
lines go; the rest, joined, is the canonical text, and its SHA-256 the digest.
Whole texts, and their single lines as notices, are joined by digest to the
known ones: a hash join with a table whose size is checked.

Null texts are empty. An empty canonical text matches nothing. Rows equal in id
and text are treated alike. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import LONG_TEXTS, NOTICES, SPELLINGS, TEXTS
from .neardup import rows_of
from .scratch import small, written

COPYRIGHT_LINE = r"^((copyright( c)?|c)( \d{4}( .*)?| by .*| year .*)?|all rights reserved)$"
_COPYRIGHT = re.compile(COPYRIGHT_LINE)
_GAP = re.compile(r"[\W_]+")


def canonical_lines(text: str) -> list[str]:
    out = []
    for line in text.replace("©", " copyright ").lower().split("\n"):
        words = _GAP.sub(" ", line).split(" ")
        x = " ".join([SPELLINGS.get(w, w) for w in words if w])
        if x and not _COPYRIGHT.match(x):
            out.append(x)
    return out


def digest(canonical: str) -> str:
    return hashlib.sha256(canonical.encode("utf-8", "replace")).hexdigest()


def known_rows() -> list[tuple[str, str]]:
    """(digest, license_id) of the licences that come with this package; a
    text counts with and without its title."""
    rows = {}
    for name, (title, body) in TEXTS.items():
        for t in (body, f"{title}\n{body}"):
            rows[digest(" ".join(canonical_lines(t)))] = name
    for name, notices in NOTICES.items():
        for t in notices:
            rows[digest(" ".join(canonical_lines(t)))] = name
    for name, known in LONG_TEXTS.items():
        rows.update(dict.fromkeys(known, name))
    return list(rows.items())


def known_digests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_rows(), "digest string, license_id string")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted: set[str] | None = None) -> DataFrame:
    """key, th, digest (null without canonical text), lines (digests of the
    canonical lines; with ``wanted``, of those in it)."""

    def run(batches):
        for batch in batches:
            whole, lines = [], []
            for t in batch.column(2).to_pylist():
                x = canonical_lines(t)
                whole.append(digest(" ".join(x)) if x else None)
                found = [digest(y) for y in x]
                lines.append(found if wanted is None else [y for y in found if y in wanted])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole, pa.string()),
                                              pa.array(lines, pa.list_(pa.string()))], names=["key", "th", "digest", "lines"])

    kind = docs.schema[key].dataType.simpleString()
    return rows_of(docs, key, text).mapInArrow(run, f"key {kind}, th bigint, digest string, lines array<string>")


def scan(docs: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, digest, license_id (of the whole text; the
    first by name if several are known under it), notices (identifiers named by
    a line, sorted), n_notice_lines."""
    known = known if known is not None else known_digests(docs.sparkSession)
    by_digest = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    wanted = None
    if small(by_digest, 150):                          # few enough to go to every task: other lines never leave it
        wanted = {r["digest"] for r in by_digest.select("digest").collect()}
        by_digest = F.broadcast(by_digest)
    rows = written(digests(docs, key, text, wanted), "license-digests")
    found = (rows.select("key", "th", F.posexplode("lines").alias("at", "digest")).join(by_digest, "digest")
             .groupBy(F.col("key").alias("_key"), F.col("th").alias("_th"))
             .agg(F.sort_array(F.collect_set("license_id")).alias("notices"),
                  F.count_distinct("at").alias("n_notice_lines")))
    whole = rows.select("key", "th", "digest").join(by_digest, "digest", "left")
    return (whole.join(found, whole["key"].eqNullSafe(found["_key"]) & (whole["th"] == found["_th"]), "left")
            .select(F.col("key").alias(key), "digest", "license_id",
                    F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
                    F.coalesce("n_notice_lines", F.lit(0)).cast("bigint").alias("n_notice_lines")))
