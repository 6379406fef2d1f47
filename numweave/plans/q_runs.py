"""Queries for run-log mining (2.10), the log parts of 2.1 / 2.4, over log
lines rendered from ``events`` (``inputs.run_log_lines``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as K
from ..operators import runs as R
from ..operators.order import global_rank
from .inputs import run_log_lines, run_log_lines_sql
from .registry import register


def _q(p: str) -> str:
    return p.replace("'", "''")


DS, ACC, R2, PER, MS, MN, TL, NAN = (_q(p) for p in (K.LOG_DATASIZE, K.LOG_ACCURACY, K.LOG_R2, K.LOG_PERIOD,
                                                        K.LOG_MODEL_SIZE, K.LOG_MODEL_NAME, K.LOG_TRAIN_LENGTH,
                                                        K.LOG_NAN))


def _x(pat, g):
    return f"CASE WHEN regexp_matches(line, '{pat}') THEN regexp_extract(line, '{pat}', {g}) END"


RUN_DIR = "regexp_replace(path, '/[^/]*$', '')"
CTE = f"""WITH {run_log_lines_sql()},
latest AS (SELECT * FROM lines WHERE path IN (SELECT max(path) FROM lines GROUP BY {RUN_DIR})),
keyed AS (SELECT *, {RUN_DIR} AS run_dir, string_split(path, '/')[-3] AS method, string_split(path, '/')[-2] AS folder,
                 contains(lower(string_split(path, '/')[-2]), 'usedigitwisetokenizer_true') AS is_digitwise,
                 CASE WHEN contains(string_split(path, '/')[-2], 'addlinear_True') THEN 'addlinear_True'
                      ELSE 'addlinear_False' END AS add_linear,
                 contains(path, 'pretrained') AS pretrained FROM latest),
fields AS (SELECT *, TRY_CAST(nullif({_x(DS, 1)}, '') AS BIGINT) AS datasize,
                  TRY_CAST({_x(ACC, 2)} AS DOUBLE) AS accuracy, TRY_CAST({_x(R2, 1)} AS DOUBLE) AS r2,
                  {_x(PER, 1)} AS period_base_list, TRY_CAST({_x(MS, 1)} AS DOUBLE) AS model_size,
                  string_split({_x(MN, 1)}, '/')[-1] AS model_name, TRY_CAST({_x(TL, 1)} AS BIGINT) AS train_length,
                  regexp_matches(line, '{NAN}') AS is_nan FROM keyed),
clean AS (SELECT * FROM fields WHERE run_dir NOT IN (SELECT run_dir FROM fields GROUP BY run_dir HAVING bool_or(is_nan))),
last AS (SELECT run_dir, {', '.join(f"arg_max({f}, line_no) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in R.FIELDS)},
                first(method) AS method, first(is_digitwise) AS is_digitwise, first(add_linear) AS add_linear,
                first(pretrained) AS pretrained FROM clean GROUP BY run_dir),
summary AS (SELECT run_dir,
                   CASE WHEN contains(lower(method), 'regular')
                        THEN method || CASE WHEN is_digitwise THEN ' (Digit-Wise)' ELSE ' (Subword)' END
                        ELSE method END AS method,
                   period_base_list, add_linear, coalesce(datasize, train_length) AS datasize, accuracy, r2,
                   model_size, model_name, pretrained FROM last)"""


def _lines(spark, sf):
    return run_log_lines(spark, sf)


def _summary(spark, sf):
    return R.run_summary(_lines(spark, sf))


@register("run_key_parse", f"""{CTE}
SELECT DISTINCT path, {RUN_DIR} AS run_dir, string_split(path, '/')[-3] AS method, string_split(path, '/')[-2] AS folder,
       contains(lower(string_split(path, '/')[-2]), 'usedigitwisetokenizer_true') AS is_digitwise,
       CASE WHEN contains(string_split(path, '/')[-2], 'addlinear_True') THEN 'addlinear_True' ELSE 'addlinear_False' END AS add_linear,
       contains(path, 'pretrained') AS pretrained FROM lines""")
def q_run_key_parse(spark, sf):
    paths = _lines(spark, sf).select("path").distinct()
    return R.run_key_parse(paths)


@register("log_latest_per_run", f"{CTE} SELECT path, count(*) AS n_lines FROM latest GROUP BY path")
def q_log_latest_per_run(spark, sf):
    return R.log_latest_per_run(_lines(spark, sf)).groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))


@register("log_extract_fields", f"""{CTE}
SELECT event_id, datasize, accuracy, r2, period_base_list, model_size, model_name, train_length, is_nan
FROM (SELECT event_id, line, TRY_CAST(nullif({_x(DS, 1)}, '') AS BIGINT) AS datasize,
             TRY_CAST({_x(ACC, 2)} AS DOUBLE) AS accuracy, TRY_CAST({_x(R2, 1)} AS DOUBLE) AS r2,
             {_x(PER, 1)} AS period_base_list, TRY_CAST({_x(MS, 1)} AS DOUBLE) AS model_size,
             string_split({_x(MN, 1)}, '/')[-1] AS model_name, TRY_CAST({_x(TL, 1)} AS BIGINT) AS train_length,
             regexp_matches(line, '{NAN}') AS is_nan FROM lines)""")
def q_log_extract_fields(spark, sf):
    f = R.log_extract_fields(_lines(spark, sf))
    return f.select("event_id", "datasize", "accuracy", "r2", "period_base_list", "model_size", "model_name",
                    "train_length", "is_nan")


@register("filter_nan_runs", f"{CTE} SELECT run_dir, count(*) AS n_lines FROM clean GROUP BY run_dir")
def q_filter_nan_runs(spark, sf):
    keyed = R.run_key_parse(R.log_latest_per_run(_lines(spark, sf)))
    clean = R.filter_nan_runs(R.log_extract_fields(keyed))
    return clean.groupBy("run_dir").agg(F.count(F.lit(1)).alias("n_lines"))


@register("log_last_value", f"""{CTE}
SELECT run_dir, {', '.join(R.FIELDS)} FROM last""")
def q_log_last_value(spark, sf):
    keyed = R.run_key_parse(R.log_latest_per_run(_lines(spark, sf)))
    last = R.log_last_value(R.filter_nan_runs(R.log_extract_fields(keyed)))
    return last.select("run_dir", *R.FIELDS)


@register("log_datasize_fallback", f"{CTE} SELECT run_dir, datasize FROM summary")
def q_log_datasize_fallback(spark, sf):
    keyed = R.run_key_parse(R.log_latest_per_run(_lines(spark, sf)))
    last = R.log_last_value(R.filter_nan_runs(R.log_extract_fields(keyed)))
    return R.log_datasize_fallback(last).select("run_dir", "datasize")


@register("log_method_label", f"{CTE} SELECT run_dir, method FROM summary")
def q_log_method_label(spark, sf):
    keyed = R.run_key_parse(R.log_latest_per_run(_lines(spark, sf)))
    last = R.log_last_value(R.filter_nan_runs(R.log_extract_fields(keyed)))
    return R.log_method_label(last).select("run_dir", "method")


SUMMARY_COLS = "run_dir, method, period_base_list, add_linear, datasize, accuracy, r2, model_size, model_name, pretrained"


@register("run_summary", f"{CTE} SELECT {SUMMARY_COLS} FROM summary")
def q_run_summary(spark, sf):
    return _summary(spark, sf)


UNION = f"""unioned AS (SELECT run_dir, CASE WHEN pretrained THEN 'Finetuned on ' || coalesce(model_name, 'Unknown') ELSE method END AS method,
                   period_base_list, add_linear, datasize, accuracy, r2, model_size FROM summary)"""


def _union(spark, sf):
    # the summary holds the runs of every base directory: relabelled in one pass
    return R.union_runs([_summary(spark, sf)])


@register("union_runs", f"{CTE}, {UNION} SELECT run_dir, method FROM unioned")
def q_union_runs(spark, sf):
    return _union(spark, sf).select("run_dir", "method")


@register("sort_curve", f"""{CTE}, {UNION}
SELECT run_dir, method, datasize, CAST(row_number() OVER (ORDER BY method NULLS FIRST, datasize NULLS FIRST, run_dir) AS INTEGER) AS position
FROM unioned""")
def q_sort_curve(spark, sf):
    s = R.sort_curve(_union(spark, sf))
    # the ordered table carries its order as a column for an order-insensitive
    # check; the position is a distributed rank, not a single-task window
    ranked = global_rank(s, ["method", "datasize", "run_dir"], out="position", start=1)
    return ranked.select("run_dir", "method", "datasize", F.col("position").cast("int").alias("position"))


@register("best_per_method", f"{CTE}, {UNION} SELECT method, max(accuracy) AS best FROM unioned GROUP BY method")
def q_best_per_method(spark, sf):
    return R.best_per_method(_union(spark, sf))


@register("best_per_method_period", f"""{CTE}, {UNION}
SELECT method, period_base_list, coalesce(max(accuracy), '-inf'::DOUBLE) AS best FROM unioned
WHERE period_base_list IS NOT NULL GROUP BY method, period_base_list""")
def q_best_per_method_period(spark, sf):
    return R.best_per_method_period(_union(spark, sf))


@register("baseline_mean", f"""{CTE}, {UNION}
SELECT method, round(avg(accuracy), 9) AS mean FROM unioned WHERE starts_with(method, 'Finetuned on') GROUP BY method""")
def q_baseline_mean(spark, sf):
    return R.baseline_mean(_union(spark, sf)).select("method", F.round("mean", 9).alias("mean"))


@register("rank_methods", f"""{CTE}, {UNION},
b AS (SELECT method, period_base_list, coalesce(max(accuracy), '-inf'::DOUBLE) AS best FROM unioned
      WHERE period_base_list IS NOT NULL GROUP BY method, period_base_list)
SELECT method, period_base_list, best,
       CAST(row_number() OVER (ORDER BY best DESC, method, period_base_list) AS INTEGER) AS rank,
       CASE WHEN best = '-inf'::DOUBLE THEN best ELSE floor(best * 1000000.0) / 1000000.0 END AS best_truncated
FROM b""")
def q_rank_methods(spark, sf):
    return R.rank_methods(_union(spark, sf))


@register("perfect_points", f"""{CTE}, {UNION}
SELECT run_dir, method, datasize, accuracy, r2 FROM unioned WHERE accuracy = 100.0 OR r2 = 1.0""")
def q_perfect_points(spark, sf):
    return R.perfect_points(_union(spark, sf)).select("run_dir", "method", "datasize", "accuracy", "r2")


@register("filter_add_linear", f"""{CTE}, {UNION}
SELECT run_dir, method, datasize, accuracy FROM unioned WHERE add_linear = 'addlinear_True'""")
def q_filter_add_linear(spark, sf):
    return R.filter_add_linear(_union(spark, sf), True).select("run_dir", "method", "datasize", "accuracy")


@register("join_ablation_diff", f"""{CTE}, {UNION},
t AS (SELECT datasize, method AS method_true, run_dir AS run_dir_true, accuracy AS accuracy_true FROM unioned
      WHERE add_linear = 'addlinear_True'),
f AS (SELECT datasize, method AS method_false, run_dir AS run_dir_false, accuracy AS accuracy_false FROM unioned
      WHERE add_linear = 'addlinear_False')
SELECT t.datasize, method_true, run_dir_true, accuracy_true, method_false, run_dir_false, accuracy_false,
       accuracy_true - accuracy_false AS accuracy_diff FROM t JOIN f ON t.datasize = f.datasize""")
def q_join_ablation_diff(spark, sf):
    return R.join_ablation_diff(_union(spark, sf))


@register("ablation_best_diff", f"""{CTE}, {UNION},
b AS (SELECT method, period_base_list, datasize, max(CASE WHEN add_linear = 'addlinear_True' THEN accuracy END) AS accuracy_true,
             max(CASE WHEN add_linear = 'addlinear_False' THEN accuracy END) AS accuracy_false
      FROM unioned GROUP BY method, period_base_list, datasize)
SELECT *, accuracy_true - accuracy_false AS accuracy_diff FROM b WHERE accuracy_true IS NOT NULL AND accuracy_false IS NOT NULL""")
def q_ablation_best_diff(spark, sf):
    return R.ablation_best_diff(_union(spark, sf))


@register("data_to_target", f"""{CTE}, {UNION},
need AS (SELECT method, min(CASE WHEN accuracy >= 99.0 THEN datasize END) AS min_datasize FROM unioned GROUP BY method)
SELECT method, min_datasize, min_datasize / (SELECT min_datasize FROM need WHERE method = 'periodic') AS ratio_to_reference
FROM need""")
def q_data_to_target(spark, sf):
    return R.data_to_target(_union(spark, sf), 99.0, reference_method="periodic")
