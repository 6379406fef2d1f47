"""Queries for the evaluation metrics (inventory 2.9) over the prediction
table derived from ``orders`` (see ``inputs.predictions``). Ratios and R^2
are rounded to 9 places, squared errors to 6, on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from . import sqlparts as S
from .inputs import PRED_FMT, epoch_metrics, epoch_metrics_sql, predictions, predictions_sql
from .registry import register

FMT = PRED_FMT
TOL = FMT.tolerance
W = f"WITH {predictions_sql()}"

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
NUMERIC = r"regexp_full_match({x}, '-?\d+(\.\d+)?')"


def _strip(x):
    return STRIP.format(x=x)


def _prefix_sql(a, p):
    return (f"len(list_filter(range(1, least(length({a}), length({p})) + 1), "
            f"lambda i: substr({a}, i, 1) = substr({p}, i, 1)))")


def _padded_sql(a, p):
    ca = f"CASE WHEN i <= length({a}) THEN substr({a}, i, 1) ELSE ' ' END"
    cp = f"CASE WHEN i <= length({p}) THEN substr({p}, i, 1) ELSE ' ' END"
    return f"len(list_filter(range(1, greatest(length({a}), length({p})) + 1), lambda i: ({ca}) = ({cp})))"


def _digit_sql(y, p):
    a = S.scaled_truncated(y, FMT.frac_len)
    b = S.scaled_truncated(p, FMT.frac_len)
    return " + ".join(f"CASE WHEN {S.digit(a, k)} = {S.digit(b, k)} THEN 1 ELSE 0 END" for k in range(FMT.n_digits))


def _tv_sql(y):
    return f"CASE WHEN min({y}) = max({y}) THEN 0.0 ELSE var_pop({y}) * count({y}) END"


def _r2_sql(sse, y, mode="nan"):
    tv = _tv_sql(y)
    if mode == "zero":
        return f"CASE WHEN ({tv}) <> 0 THEN 1 - ({sse}) / ({tv}) ELSE 0.0 END"
    cond = f"({tv}) > 0" + (f" AND count({y}) > 1" if mode == "nan_small" else "")
    return f"CASE WHEN {cond} THEN 1 - ({sse}) / ({tv}) ELSE 'nan'::DOUBLE END"


def _pred(spark, sf):
    return predictions(spark, sf, indexed=False)


@register("acc_tolerance", f"""{W}
SELECT run, round(avg(CASE WHEN abs(prediction - label) < {TOL!r} THEN 1.0 ELSE 0.0 END), 9) AS whole_number_accuracy
FROM pred GROUP BY run""")
def q_acc_tolerance(spark, sf):
    return M.acc_tolerance(_pred(spark, sf), ["run"], TOL).select(
        "run", F.round("whole_number_accuracy", 9).alias("whole_number_accuracy"))


@register("acc_exact_string", f"""{W}
SELECT run, round(avg(CASE WHEN {_strip('label_text')} = {_strip('pred_text')} THEN 1.0 ELSE 0.0 END), 9)
       AS whole_number_accuracy
FROM pred GROUP BY run""")
def q_acc_exact_string(spark, sf):
    return M.acc_exact_string(_pred(spark, sf), ["run"]).select(
        "run", F.round("whole_number_accuracy", 9).alias("whole_number_accuracy"))


@register("acc_char_prefix", f"""{W}
SELECT run, round(sum({_prefix_sql('label_text', 'pred_text')}) / sum(length(label_text)), 9) AS digit_wise_accuracy
FROM pred GROUP BY run""")
def q_acc_char_prefix(spark, sf):
    return M.acc_char_prefix(_pred(spark, sf), ["run"]).select(
        "run", F.round("digit_wise_accuracy", 9).alias("digit_wise_accuracy"))


@register("acc_char_padded", f"""{W}
SELECT run, round(sum({_padded_sql('a', 'p')}) / sum(greatest(length(a), length(p))), 9) AS digit_wise_accuracy
FROM (SELECT run, {_strip('label_text')} AS a, {_strip('pred_text')} AS p FROM pred) GROUP BY run""")
def q_acc_char_padded(spark, sf):
    return M.acc_char_padded(_pred(spark, sf), ["run"]).select(
        "run", F.round("digit_wise_accuracy", 9).alias("digit_wise_accuracy"))


@register("acc_digit", f"""{W}
SELECT run, round(sum({_digit_sql('label', 'prediction')}) / (count(*) * {FMT.n_digits}), 9) AS digit_wise_accuracy
FROM pred GROUP BY run""")
def q_acc_digit(spark, sf):
    return M.acc_digit(_pred(spark, sf), ["run"], FMT).select(
        "run", F.round("digit_wise_accuracy", 9).alias("digit_wise_accuracy"))


@register("agg_mse", f"""{W}
SELECT run, round(avg(pow(prediction - label, 2)), 6) AS mse FROM pred GROUP BY run""")
def q_agg_mse(spark, sf):
    return M.agg_mse(_pred(spark, sf), ["run"]).select("run", F.round("mse", 6).alias("mse"))


@register("agg_mse_numeric_only", f"""{W}
SELECT run, round(coalesce(avg(CASE WHEN {NUMERIC.format(x=_strip('pred_text'))}
                            THEN pow(CAST({_strip('pred_text')} AS DOUBLE) - CAST({_strip('label_text')} AS DOUBLE), 2) END),
                       -1.0), 6) AS mse
FROM pred GROUP BY run""")
def q_agg_mse_numeric_only(spark, sf):
    return M.agg_mse_numeric_only(_pred(spark, sf), ["run"]).select("run", F.round("mse", 6).alias("mse"))


@register("agg_r2", f"""{W}
SELECT run, round({_r2_sql('sum(pow(prediction - label, 2))', 'label')}, 9) AS r2 FROM pred GROUP BY run""")
def q_agg_r2(spark, sf):
    return M.agg_r2(_pred(spark, sf), ["run"]).select("run", F.round("r2", 9).alias("r2"))


@register("agg_loss_batch_mean", f"""{W}
SELECT run, round(avg(bl), 6) AS test_loss FROM (SELECT run, batch_id, avg(loss) AS bl FROM pred GROUP BY run, batch_id)
GROUP BY run""")
def q_agg_loss_batch_mean(spark, sf):
    return M.agg_loss_batch_mean(predictions(spark, sf), ["run"]).select("run", F.round("test_loss", 6).alias("test_loss"))


def _report_sql(method):
    if method == "regular":
        a, p = _strip("label_text"), _strip("pred_text")
        ok = NUMERIC.format(x=p)
        yn, pn = f"CASE WHEN {ok} THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {ok} THEN CAST({p} AS DOUBLE) END"
        acc = f"avg(CASE WHEN {a} = {p} THEN 1.0 ELSE 0.0 END)"
        digit = f"sum({_padded_sql(a, p)}) / sum(greatest(length({a}), length({p})))"
        mse = f"coalesce(avg(pow(({pn}) - ({yn}), 2)), -1.0)"
        r2 = _r2_sql(f"sum(pow(({pn}) - ({yn}), 2))", f"({yn})")
    else:
        tol = 0.5 if method == "logscale" else TOL
        acc = f"avg(CASE WHEN abs(prediction - label) < {tol!r} THEN 1.0 ELSE 0.0 END)"
        if method == "digits":
            digit = f"sum({_digit_sql('label', 'prediction')}) / (count(*) * {FMT.n_digits})"
        else:
            digit = f"sum({_prefix_sql('label_text', 'CAST(prediction AS VARCHAR)')}) / sum(length(label_text))"
        mse = "avg(pow(prediction - label, 2))"
        r2 = _r2_sql("sum(pow(prediction - label, 2))", "label",
                     {"periodic": "nan", "logscale": "nan_small", "digits": "zero"}[method])
    return f"""SELECT '{method}' AS method, m.run, n, whole_number_accuracy, digit_wise_accuracy, mse, r2,
       round(l.test_loss, 6) AS test_loss FROM
  (SELECT run, count(*) AS n, round({acc}, 9) AS whole_number_accuracy, round({digit}, 9) AS digit_wise_accuracy,
          round({mse}, 6) AS mse, round({r2}, 9) AS r2 FROM pred GROUP BY run) m
  JOIN (SELECT run, avg(bl) AS test_loss FROM (SELECT run, batch_id, avg(loss) AS bl FROM pred GROUP BY run, batch_id)
        GROUP BY run) l ON m.run = l.run"""


@register("eval_report", W + "\n" + "\nUNION ALL\n".join(_report_sql(m) for m in M.METHODS))
def q_eval_report(spark, sf):
    r = M.eval_reports(predictions(spark, sf), ["run"], FMT)
    return r.select(
        "method", "run", "n", F.round("whole_number_accuracy", 9).alias("whole_number_accuracy"),
        F.round("digit_wise_accuracy", 9).alias("digit_wise_accuracy"), F.round("mse", 6).alias("mse"),
        F.round("r2", 9).alias("r2"), F.round("test_loss", 6).alias("test_loss"))


@register("topk_mispredictions", f"""{W}
SELECT run, CAST(rank AS INTEGER) AS rank, idx, label, prediction FROM (
  SELECT run, idx, label, prediction, row_number() OVER (PARTITION BY run ORDER BY idx) AS rank
  FROM pred WHERE NOT (abs(prediction - label) < {TOL!r})) WHERE rank <= 5""")
def q_topk_mispredictions(spark, sf):
    return M.topk_mispredictions(predictions(spark, sf), ["run"], "idx", 5, TOL).select(
        "run", "rank", "idx", "label", "prediction")


@register("sample_predictions", f"""{W}
SELECT run, CAST(rank AS INTEGER) AS rank, idx, label, prediction FROM (
  SELECT run, idx, label, prediction, row_number() OVER (PARTITION BY run ORDER BY idx) AS rank FROM pred)
WHERE rank <= 5""")
def q_sample_predictions(spark, sf):
    return M.sample_predictions(predictions(spark, sf), ["run"], "idx", 5).select(
        "run", "rank", "idx", "label", "prediction")


@register("early_stop_epoch", f"""WITH {epoch_metrics_sql()},
s AS (SELECT run, min(CASE WHEN whole_number_accuracy = 1.0 THEN epoch END) AS stop_epoch FROM em GROUP BY run)
SELECT em.run, epoch, whole_number_accuracy, stop_epoch FROM em JOIN s ON em.run = s.run
WHERE stop_epoch IS NULL OR epoch <= stop_epoch""")
def q_early_stop_epoch(spark, sf):
    return M.early_stop_epoch(epoch_metrics(spark, sf), ["run"]).select(
        "run", "epoch", "whole_number_accuracy", "stop_epoch")
