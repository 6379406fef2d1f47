"""Corpus pipeline: quality rules, toxicity, line dedup, near-dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and hands the table it reads back
to the next stage. All stages but the last return the columns of documents.

Defined cases: rows with null or empty text fail the quality rules and go;
rows with a null id are judged like others (their labels are unknown); rows
equal in id and text are one document from the line stage on, so one of them
stays after near-dedup; extra columns pass through; an empty table gives empty
results in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numweave.llm import linededup, neardup, packing, quality, toxicity
from numweave.llm.queries import ORACLE  # noqa: F401
from numweave.llm.queries import QUERIES as OPERATORS
from numweave.llm.queries import tokenizer_file
from numweave.llm.scratch import discard, read_table, small_batches, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep (operator 8)."""
    small_batches(spark)
    measured = written(quality.measures(docs), "quality")
    rules = quality.train(measured, read_table(spark, sf_dir, "labels"))
    return quality.kept(docs, rules)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold (operator 4)."""
    small_batches(spark)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that another place already has (operator 9)."""
    small_batches(spark)
    out = linededup.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicates (operator 10)."""
    small_batches(spark)
    return neardup.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 ids (operator 3)."""
    small_batches(spark)
    return packing.pieces(packing.stream(docs, tokenizer_file("byte_bpe_50k.json"), added=True, packed=True), 1024, with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", pack),
]

#: SQL expresses neither the learned stages nor the similarity stages; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)                                 # the stage's own table, never the input
    return docs


QUERIES = {**OPERATORS, "pipeline": run}
