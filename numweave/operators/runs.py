"""Run-log mining (inventory 2.10 and the log parts of 2.1 / 2.4).

Input: a line table ``(path, line_no, line)`` — one row per log line, with
``path`` = ``.../<method>/<run folder>/<log file>``. Everything below is
regex projections plus per-run aggregates (``max_by`` for last-wins fields,
``bool_or`` for the nan rule); no per-run Python, no collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (LOG_ACCURACY, LOG_DATASIZE, LOG_MODEL_NAME, LOG_MODEL_SIZE, LOG_NAN, LOG_PERIOD, LOG_R2,
                      LOG_TRAIN_LENGTH)
from ..functions.numeric import truncate_float

FIELDS = ("datasize", "accuracy", "r2", "period_base_list", "model_size", "model_name", "train_length")


def run_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def run_key_parse(df: DataFrame, path_col: str = "path") -> DataFrame:
    """From ``.../<method>/<folder>/<file>``: run directory, method, folder,
    digit-wise flag (case-insensitive), add-linear flag, pretrained flag."""
    p = F.col(path_col)
    parts = F.split(p, "/")
    folder = F.element_at(parts, -2)
    return (df.withColumn("run_dir", run_dir(p))
            .withColumn("method", F.element_at(parts, -3))
            .withColumn("folder", folder)
            .withColumn("is_digitwise", F.lower(folder).contains("usedigitwisetokenizer_true"))
            .withColumn("add_linear", F.when(folder.contains("addlinear_True"), "addlinear_True")
                        .otherwise("addlinear_False"))
            .withColumn("pretrained", p.contains("pretrained")))


def log_latest_per_run(lines: DataFrame, path_col: str = "path") -> DataFrame:
    """Keep the lines of one log per run directory: the greatest file name
    (the timestamp in ``training_log_<ts>.log``). Per-run maxima are a small
    aggregate joined back with a left-semi join."""
    p = F.col(path_col)
    latest = lines.groupBy(run_dir(p).alias("_rd")).agg(F.max(p).alias("_latest"))
    return lines.join(latest, p == F.col("_latest"), "left_semi")


def _extract(line: Column, pattern: str, group: int) -> Column:
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group))


def log_extract_fields(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Seven patterns per line -> typed nullable columns. One match per pattern:
    no match and an empty one are both NULL, except for the period list, which
    may be empty."""
    ln = F.col(line_col)

    def part(pattern, group):
        return F.nullif(F.regexp_extract(ln, pattern, group), F.lit(""))

    return (lines
            .withColumn("datasize", part(LOG_DATASIZE, 1).try_cast("bigint"))
            .withColumn("accuracy", part(LOG_ACCURACY, 2).try_cast("double"))
            .withColumn("r2", part(LOG_R2, 1).try_cast("double"))
            .withColumn("period_base_list", _extract(ln, LOG_PERIOD, 1))
            .withColumn("model_size", part(LOG_MODEL_SIZE, 1).try_cast("double"))
            .withColumn("model_name", F.substring_index(part(LOG_MODEL_NAME, 1), "/", -1))
            .withColumn("train_length", part(LOG_TRAIN_LENGTH, 1).try_cast("bigint"))
            .withColumn("is_nan", ln.rlike(LOG_NAN)))


def filter_nan_runs(fields: DataFrame, run_cols=("run_dir",)) -> DataFrame:
    """Drop every run with a ``Loss nan`` line (left-anti join against the
    per-run flag)."""
    run_cols = list(run_cols)
    bad = fields.groupBy(*run_cols).agg(F.bool_or("is_nan").alias("_bad")).filter("_bad")
    return fields.join(bad.select(*run_cols), run_cols, "left_anti")


def log_last_value(fields: DataFrame, run_cols=("run_dir",), order_col: str = "line_no",
                   keep=("method", "folder", "is_digitwise", "add_linear", "pretrained")) -> DataFrame:
    """Value of every field at its greatest line (NULLs skipped), one
    aggregate per run."""
    run_cols = list(run_cols)
    o = F.col(order_col)
    aggs = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), o)).alias(f) for f in FIELDS]
    aggs += [F.first(k).alias(k) for k in keep]
    return fields.groupBy(*run_cols).agg(*aggs)


def run_records(lines: DataFrame, methods=None, path_col: str = "path", line_col: str = "line",
                order_col: str = "line_no") -> DataFrame:
    """One scan: per log file the last value of every field and whether a loss
    was nan, then per run directory the record of its greatest file name; runs
    with a nan loss there are dropped. ``methods`` filters before any regex."""
    keep = ["method", "folder", "is_digitwise", "add_linear", "pretrained"]
    keyed = run_key_parse(lines, path_col)
    if methods is not None:
        keyed = keyed.filter(F.col("method").isin(list(methods)))
    fields = log_extract_fields(keyed, line_col)
    o = F.col(order_col)
    per_log = fields.groupBy("run_dir", F.col(path_col).alias("_path")).agg(
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), o)).alias(f) for f in FIELDS],
        *[F.first(k).alias(k) for k in keep], F.bool_or("is_nan").alias("_nan"))
    latest = per_log.groupBy("run_dir").agg(F.max_by(F.struct(*FIELDS, *keep, "_nan"), "_path").alias("r"))
    return latest.select("run_dir", "r.*").filter(~F.coalesce("_nan", F.lit(False))).drop("_nan")


def log_datasize_fallback(runs: DataFrame) -> DataFrame:
    """datasize from ``num_train_samples``; else ``Train dataset length``."""
    return runs.withColumn("datasize", F.coalesce("datasize", "train_length"))


def log_method_label(runs: DataFrame, method_col: str = "method", digit_col: str = "is_digitwise") -> DataFrame:
    m = F.col(method_col)
    return runs.withColumn(method_col, F.when(
        F.lower(m).contains("regular"),
        F.concat(m, F.when(F.col(digit_col), F.lit(" (Digit-Wise)")).otherwise(F.lit(" (Subword)")))).otherwise(m))


def run_summary(lines: DataFrame, methods=None, is_model_size: bool = True, path_col: str = "path",
                line_col: str = "line", order_col: str = "line_no") -> DataFrame:
    """Line table -> one summary row per run:
    method, period_base_list, add_linear, datasize, accuracy, r2[, model_size]."""
    runs = log_method_label(log_datasize_fallback(run_records(lines, methods, path_col, line_col, order_col)))
    cols = ["run_dir", "method", "period_base_list", "add_linear", "datasize", "accuracy", "r2", "model_name",
            "pretrained"]
    if is_model_size:
        cols.insert(7, "model_size")
    return runs.select(*cols)


def union_runs(tables) -> DataFrame:
    """Concatenate run tables; runs from a pretrained base are relabelled
    ``Finetuned on <model>``."""
    out = None
    for t in tables:
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    model = F.coalesce(F.col("model_name"), F.lit("Unknown"))
    return out.withColumn("method", F.when(F.col("pretrained"), F.concat(F.lit("Finetuned on "), model))
                          .otherwise(F.col("method")))


def filter_add_linear(runs: DataFrame, flag: bool) -> DataFrame:
    return runs.filter(F.col("add_linear") == ("addlinear_True" if flag else "addlinear_False"))


DEAL = 32                   # an x with more than 1 / DEAL of a side's rows is dealt out


def join_ablation_diff(runs: DataFrame, x_key: str = "datasize", y_key: str = "accuracy") -> DataFrame:
    """Inner join of the add-linear True / False subsets on x (many-to-many
    when several runs share x), y difference, ordered by x.

    Runs per x are counted on both sides. The output cells of a heavy x form a
    grid: either side's rows are dealt over parts in proportion to their number
    and meet every part of the other side, so that no task makes more than
    about 1 / DEAL of a side times 1 / DEAL of the other for one x. The result
    is sorted by x and then by run, so a heavy x is many sort ranges, too."""
    def side(flag, suffix):
        return filter_add_linear(runs, flag).filter(F.col(x_key).isNotNull()).select(
            F.col(x_key), *[F.col(c).alias(f"{c}_{suffix}") for c in ("method", "run_dir", y_key)])

    flag = F.col("add_linear") == "addlinear_True"
    other = F.col("add_linear") == "addlinear_False"
    counts = runs.filter((flag | other) & F.col(x_key).isNotNull()).groupBy(x_key).agg(F.count_if(flag).alias("_nt"), F.count_if(other).alias("_nf"))
    total = counts.agg(F.struct(F.sum("_nt").alias("t"), F.sum("_nf").alias("f"))).scalar()
    parts = lambda n, of: F.greatest(F.ceil(F.col(n) * F.lit(float(DEAL)) / of), F.lit(1)).cast("int")
    heavy = F.broadcast(counts.select(x_key, parts("_nt", total.getField("t")).alias("_pt"), parts("_nf", total.getField("f")).alias("_pf"))
                        .filter("_pt > 1 or _pf > 1"))                                            # fewer than 2 * DEAL rows

    def dealt(df, suffix, mine, others):
        one, every = F.coalesce(mine, F.lit(1)), F.coalesce(others, F.lit(1))
        keys = [F.col(f"{c}_{suffix}") for c in ("method", "run_dir", y_key)]
        out = df.join(heavy, x_key, "left").withColumn("_own", F.pmod(F.xxhash64(*keys), one).cast("int"))
        return out.withColumn("_met", F.explode(F.sequence(F.lit(0), every - 1))).drop("_pt", "_pf")

    t = dealt(side(True, "true"), "true", F.col("_pt"), F.col("_pf")).withColumnsRenamed({"_own": "_i", "_met": "_j"})
    f = dealt(side(False, "false"), "false", F.col("_pf"), F.col("_pt")).withColumnsRenamed({"_own": "_j", "_met": "_i"})
    j = t.join(f, [x_key, "_i", "_j"]).drop("_i", "_j")
    return (j.withColumn(f"{y_key}_diff", F.col(f"{y_key}_true") - F.col(f"{y_key}_false"))
            .orderBy(x_key, "method_true", "run_dir_true", "method_false", "run_dir_false"))


def ablation_best_diff(runs: DataFrame, x_key: str = "datasize", y_key: str = "accuracy") -> DataFrame:
    """The ablation per curve: best y of every (method, period list, x) with and
    without the linear layer, one row each before the two sides meet, so the
    result never outgrows the curves."""
    best = F.max(F.when(F.col("add_linear") == "addlinear_True", F.col(y_key)))
    other = F.max(F.when(F.col("add_linear") == "addlinear_False", F.col(y_key)))
    return (runs.groupBy("method", "period_base_list", x_key).agg(best.alias(f"{y_key}_true"), other.alias(f"{y_key}_false"))
            .filter(F.col(f"{y_key}_true").isNotNull() & F.col(f"{y_key}_false").isNotNull())
            .withColumn(f"{y_key}_diff", F.col(f"{y_key}_true") - F.col(f"{y_key}_false")))


def sort_curve(runs: DataFrame, x_key: str = "datasize") -> DataFrame:
    return runs.orderBy("method", x_key)


def best_per_method(runs: DataFrame, y_key: str = "accuracy") -> DataFrame:
    return runs.groupBy("method").agg(F.max(y_key).alias("best"))


def best_per_method_period(runs: DataFrame, y_key: str = "accuracy") -> DataFrame:
    """Per (method, period list): best y; rows without a period list drop out
    (as a pandas groupby drops NaN keys); all-NULL y -> -inf."""
    return (runs.filter(F.col("period_base_list").isNotNull())
            .groupBy("method", "period_base_list")
            .agg(F.coalesce(F.max(y_key), F.lit(float("-inf"))).alias("best")))


def baseline_mean(runs: DataFrame, y_key: str = "accuracy") -> DataFrame:
    """Fine-tuned methods on the model-size axis: one horizontal mean each."""
    return runs.filter(F.col("method").startswith("Finetuned on")).groupBy("method").agg(
        F.avg(y_key).alias("mean"))


def rank_methods(runs: DataFrame, y_key: str = "accuracy") -> DataFrame:
    """Legend order: (method, period) lines by best value descending, with the
    best value truncated to 6 decimals. The ranked table has one row per
    line, so the global window is bounded by the number of curves."""
    best = best_per_method_period(runs, y_key)
    w = Window.orderBy(F.desc("best"), F.asc("method"), F.asc("period_base_list"))
    return best.withColumn("rank", F.row_number().over(w)).withColumn(
        "best_truncated", F.when(F.col("best") == float("-inf"), F.col("best")).otherwise(truncate_float("best", 6)))


def perfect_points(runs: DataFrame) -> DataFrame:
    return runs.filter((F.col("accuracy") == 100.0) | (F.col("r2") == 1.0))


def data_to_target(runs: DataFrame, target: float = 99.0, reference_method: str | None = None) -> DataFrame:
    """Least training size reaching ``target`` accuracy per method and its
    ratio to a reference method's (how much less data one method needs)."""
    need = runs.groupBy("method").agg(
        F.min(F.when(F.col("accuracy") >= F.lit(target), F.col("datasize"))).alias("min_datasize"))
    if reference_method is None:
        return need
    ref = need.filter(F.col("method") == reference_method).select(F.col("min_datasize").alias("_ref")).scalar()
    return need.withColumn("ratio_to_reference", F.try_divide(F.col("min_datasize").cast("double"), ref))
