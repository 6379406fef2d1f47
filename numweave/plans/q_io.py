"""Queries for sources and sinks (2.1): each writes data derived from the
tables below ``spark.checkpoint.dir`` and reads it back through the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import hash_order
from ..operators import generate as G
from ..operators import split as P
from ..operators.order import global_index
from ..sources import datasets as DS
from ..sources import logs as LG
from ..sources import sinks as SK
from ..sources.paths import scratch_path
from . import sqlparts as S
from .inputs import epoch_metrics, epoch_metrics_sql, run_log_lines, run_log_lines_sql
from .q_generate import ADD, DEC, _pair_sql
from .registry import register, table

QA_SEED = 81


def _qa_split(spark, sf):
    qa = G.gen_pairs_add(table(spark, sf, "orders"), ["o_orderkey"], ADD["max_value"], ADD["n"], ADD["seed"])
    return _split(qa)


def _split(qa):
    qa = qa.withColumn("_h", hash_order(QA_SEED, "question"))
    return P.split_positional(global_index(qa, ["_h", "question"])).drop("_h", "idx")


_QA_SPLIT_SQL = f"""qa AS ({_pair_sql(ADD, "+", limit=ADD["n"])}),
i AS (SELECT question, label, row_number() OVER (ORDER BY {S.hash_order(QA_SEED, 'question')}, question) - 1 AS idx FROM qa),
c AS (SELECT CAST(trunc(n * 0.8::DOUBLE * 0.9::DOUBLE) AS BIGINT) AS c1, CAST(trunc(n * 0.8::DOUBLE * 0.1::DOUBLE) AS BIGINT) AS c2
      FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM qa)),
sp AS (SELECT question, label, CASE WHEN idx < c1 THEN 'train' WHEN idx < c1 + c2 THEN 'validation' ELSE 'test' END AS split
       FROM i, c)"""


@register("sink_split_csv", f"WITH {_QA_SPLIT_SQL} SELECT question, label, split FROM sp")
def q_sink_split_csv(spark, sf):
    path = scratch_path(spark, "splits")
    DS.sink_split_csv(_qa_split(spark, sf), path)
    return DS.src_split_dataset(spark, path, DS.INTEGER_QA_SCHEMA).select("question", "label", "split")


_DEC_SPLIT_SQL = _QA_SPLIT_SQL.replace(_pair_sql(ADD, "+", limit=ADD["n"]), _pair_sql(
    DEC, "+", label="(lo + hi) / 1000.0", text=lambda c: f"CAST({c} / 1000.0 AS VARCHAR)", limit=DEC["n"]))


@register("sink_split_csv_decimal", f"WITH {_DEC_SPLIT_SQL} SELECT question, CAST(label AS DOUBLE) AS label, split FROM sp")
def q_sink_split_csv_decimal(spark, sf):
    path = scratch_path(spark, "splits-decimal")
    qa = G.gen_pairs_add_decimal(table(spark, sf, "orders"), ["o_orderkey"], DEC["max_value"], DEC["n"], DEC["seed"])
    DS.sink_split_csv(_split(qa), path)
    return DS.src_split_dataset(spark, path).select("question", "label", "split")


@register("src_split_dataset", f"""WITH {_QA_SPLIT_SQL}
SELECT question, label,
       CASE WHEN CAST({S.hash_order(42, 'question')} AS DOUBLE) / {float(1 << 60)!r} < 0.1 THEN 'test' ELSE 'train' END AS split
FROM sp WHERE split = 'train'""")
def q_src_split_dataset(spark, sf):
    path = scratch_path(spark, "train-only")
    DS.sink_split_csv(_qa_split(spark, sf).filter(F.col("split") == "train"), path)
    return DS.src_split_dataset(spark, path, DS.INTEGER_QA_SCHEMA).select("question", "label", "split")


@register("src_run_logs", f"""WITH {run_log_lines_sql()},
m AS (SELECT regexp_replace(path, '/run[^/]+/[^/]+$', '') AS path, line_no, line FROM lines)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY line_no) - 1 AS line_no, line FROM m""")
def q_src_run_logs(spark, sf):
    """One long log per method, written as text and read back in splits."""
    root = scratch_path(spark, "runlogs")
    LG.write_run_logs(run_log_lines(spark, sf).withColumn("path", F.regexp_replace("path", "/run[^/]+/[^/]+$", "")), root)
    return LG.read_written_logs(spark, root)


@register("src_run_logs_table", f"""WITH {run_log_lines_sql()}
SELECT path, row_number() OVER (PARTITION BY path ORDER BY line_no) - 1 AS line_no, line FROM lines""")
def q_src_run_logs_table(spark, sf):
    """Run logs rendered from events, stored as a run-log table and read back."""
    path = scratch_path(spark, "runlogs")
    LG.write_run_log_table(run_log_lines(spark, sf), path)
    return LG.read_run_log_table(spark, path)


@register("src_run_logs_tree", f"""WITH {run_log_lines_sql()}
SELECT regexp_replace(path, '/[^/]+$', '') AS path,
       row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]+$', '') ORDER BY line_no) - 1 AS line_no, line FROM lines""")
def q_src_run_logs_tree(spark, sf):
    """One log file per run directory, read back from the tree of files."""
    root = scratch_path(spark, "runlog-tree")
    LG.write_run_logs(run_log_lines(spark, sf).withColumn("path", F.regexp_replace("path", "/[^/]+$", "")), root)
    return LG.read_written_logs(spark, root)


@register("sink_metrics", f"""WITH {epoch_metrics_sql()}
SELECT run, epoch, whole_number_accuracy, round(test_loss, 9) AS test_loss FROM em""")
def q_sink_metrics(spark, sf):
    """Two batches (odd and even epochs), the second one written twice."""
    path = scratch_path(spark, "metrics")
    em = epoch_metrics(spark, sf)
    for name, rows in (("odd", em.filter("epoch % 2 = 1")), ("even", em.filter("epoch % 2 = 0")), ("even", em.filter("epoch % 2 = 0"))):
        SK.sink_metrics(rows, path, "run", batch_id=name)
    return SK.read_metrics(spark, path).select("run", "epoch", "whole_number_accuracy", F.round("test_loss", 9).alias("test_loss"))


_LOSS_RE = r"Loss\s+(\S+)$"


@register("sink_quarantine", f"""WITH {run_log_lines_sql()}
SELECT event_id, loss FROM (
  SELECT event_id, TRY_CAST(regexp_extract(line, '{_LOSS_RE}', 1) AS DOUBLE) AS loss FROM lines
  WHERE regexp_matches(line, '{_LOSS_RE}'))
WHERE loss IS NULL OR (NOT isnan(loss) AND NOT isinf(loss))""")
def q_sink_quarantine(spark, sf):
    losses = _losses(spark, sf)
    return SK.sink_quarantine(losses, ["loss"], scratch_path(spark, "quarantine"))


@register("sink_quarantine_diverted", f"""WITH {run_log_lines_sql()}
SELECT event_id, loss FROM (
  SELECT event_id, TRY_CAST(regexp_extract(line, '{_LOSS_RE}', 1) AS DOUBLE) AS loss FROM lines
  WHERE regexp_matches(line, '{_LOSS_RE}'))
WHERE isnan(loss) OR isinf(loss)""")
def q_sink_quarantine_diverted(spark, sf):
    losses, path = _losses(spark, sf), scratch_path(spark, "quarantine")
    SK.sink_quarantine(losses, ["loss"], path)
    return SK.read_quarantine(spark, path, losses.schema)


def _losses(spark, sf):
    lines = run_log_lines(spark, sf).filter(F.col("line").rlike(_LOSS_RE))
    return lines.select("event_id", F.regexp_extract("line", _LOSS_RE, 1).try_cast("double").alias("loss"))
