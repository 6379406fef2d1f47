"""Inputs derived from the given tables for operators whose reference inputs
are model outputs (predictions, epoch metrics, hidden states, run logs).

Each builder has a Spark form and the equivalent DuckDB CTE, so every
downstream query reads the tables and grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BATCH_SIZE, NumberFormat
from ..functions.numeric import hash_order
from ..functions.text import py_float_str, py_float_str_sql
from ..operators.order import global_index
from . import sqlparts as S
from .registry import table

# Prediction table: label = o_totalprice / 1000 (3 integer, up to 5 decimal
# digits); the prediction is a deterministic perturbation chosen by a hash of
# the order key: 60 % exact, then +1e-5, +0.5, floor, x2 (10 % each).
PRED_FMT = NumberFormat(int_len=3, frac_len=5, bases=(2.0, 5.0), dim=64)
PRED_SEED, BATCH_SEED = 99, 100


def predictions(spark, sf: str, indexed: bool = True) -> DataFrame:
    """``indexed=False`` leaves out idx and batch_id, and with them the index over all rows."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("run"),
        (F.col("o_totalprice") / F.lit(1000.0)).alias("label"))
    u = F.pmod(hash_order(PRED_SEED, "o_orderkey"), F.lit(10))
    y = F.col("label")
    pred = (F.when(u < 6, y).when(u == 6, y + F.lit(1e-5)).when(u == 7, y + F.lit(0.5))
            .when(u == 8, F.floor(y).cast("double")).otherwise(y * F.lit(2.0)))
    o = o.withColumn("_u", u).withColumn("prediction", pred)
    place = []
    if indexed:
        o = o.withColumn("_h", hash_order(BATCH_SEED, "o_orderkey"))
        o = global_index(o, ["_h", "o_orderkey"], out="idx", group_cols=["run"])
        place = ["idx", F.call_function("div", F.col("idx"), F.lit(BATCH_SIZE)).alias("batch_id")]
    return o.select(
        "o_orderkey", "run", "label", "prediction", *place,
        F.pow(F.col("prediction") - F.col("label"), 2).alias("loss"),
        py_float_str("label").alias("label_text"),
        F.when(F.col("_u") == 9, F.concat(py_float_str("prediction"), F.lit("?")))
        .otherwise(py_float_str("prediction")).alias("pred_text"),
    )


def predictions_sql() -> str:
    y = "(o_totalprice / 1000.0::DOUBLE)"
    return f"""pred AS (
  SELECT o_orderkey, run, label, prediction, idx, idx // {BATCH_SIZE} AS batch_id,
         pow(prediction - label, 2) AS loss, CAST(label AS VARCHAR) AS label_text,
         CASE WHEN u = 9 THEN CAST(prediction AS VARCHAR) || '?' ELSE CAST(prediction AS VARCHAR) END AS pred_text
  FROM (
    SELECT o_orderkey, o_orderpriority AS run, {y} AS label, u,
           CASE WHEN u < 6 THEN {y} WHEN u = 6 THEN {y} + 1e-5 WHEN u = 7 THEN {y} + 0.5::DOUBLE
                WHEN u = 8 THEN CAST(floor({y}) AS DOUBLE) ELSE {y} * 2.0::DOUBLE END AS prediction,
           row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) - 1 AS idx
    FROM (SELECT *, {S.hash_order(PRED_SEED, 'o_orderkey')} % 10 AS u,
                 {S.hash_order(BATCH_SEED, 'o_orderkey')} AS h FROM orders)))"""


# Epoch metric records: one run per user, one epoch per day of month;
# accuracy = min(max(value) / 350, 1) so some runs reach exactly 1.0.
def epoch_metrics(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("run"), F.dayofmonth("ts").cast("int").alias("epoch")).agg(
        F.least(F.max("value") / F.lit(350.0), F.lit(1.0)).alias("whole_number_accuracy"),
        F.avg("value").alias("test_loss"))


def epoch_metrics_sql() -> str:
    return """em AS (
  SELECT user_id AS run, CAST(day(ts) AS INTEGER) AS epoch,
         least(max(value) / 350.0::DOUBLE, 1.0::DOUBLE) AS whole_number_accuracy, avg(value) AS test_loss
  FROM events GROUP BY user_id, CAST(day(ts) AS INTEGER))"""


# Run logs rendered from events: one run per user, one log file per user and
# day, one line per event (in time order), line text by event type, written
# the way the training script logs (metric names padded to 40 columns).
LOG_METHODS = ("periodic", "logscale", "digits", "regular")
ACC_NAMES = ("Whole Num Accuracy", "Whole Number Accuracy", "Whole Num Acc")
PERIOD_LISTS = ("2, 5", "10", "2, 5, 10")


def run_log_lines(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    u, eid, v = F.col("user_id"), F.col("event_id"), F.col("value")
    base = F.when(F.pmod(u, F.lit(5)) == 0, F.lit("pretrained")).otherwise(F.lit("scratch"))
    method = F.element_at(F.array(*[F.lit(m) for m in LOG_METHODS]), (F.pmod(u, F.lit(4)) + 1).cast("int"))
    folder = F.concat(F.lit("run"), u.cast("string"),
                      F.lit("_addlinear_"), F.when(F.pmod(u, F.lit(3)) == 0, "True").otherwise("False"),
                      F.lit("_usedigitwisetokenizer_"), F.when(F.pmod(u, F.lit(2)) == 0, "True").otherwise("False"))
    fname = F.concat(F.lit("training_log_"), F.date_format("ts", "yyyyMMdd"), F.lit(".log"))
    path = F.concat_ws("/", F.lit("result/add"), base, method, folder, fname)
    prefix = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" - INFO - "))
    k12 = F.pmod(eid, F.lit(12)).cast("int")
    datasize = F.when(F.pmod(eid, F.lit(13)) == 0, F.lit("None")).otherwise(
        F.call_function("shiftleft", F.lit(100).cast("bigint"), k12).cast("string"))
    period = F.element_at(F.array(*[F.lit(p) for p in PERIOD_LISTS]), (F.pmod(eid, F.lit(3)) + 1).cast("int"))
    namespace = F.concat(
        F.lit("Namespace(batch_size=512, model='org/model-"), F.pmod(u, F.lit(3)).cast("string"),
        F.lit("', num_train_samples="), datasize,
        F.when(method != "regular", F.concat(F.lit(", period_base_list=["), period, F.lit("]"))).otherwise(F.lit("")),
        F.lit(", epochs=100)"))
    acc_name = F.element_at(F.array(*[F.lit(a) for a in ACC_NAMES]), (F.pmod(eid, F.lit(3)) + 1).cast("int"))
    acc = F.concat(F.rpad(acc_name, 40, " "), py_float_str_sql("least(value, 100.0D)"), F.lit("%"))
    r2 = F.concat(F.rpad(F.lit("R^2"), 40, " "), py_float_str_sql("1.0D - value / 400.0D"))
    size = F.when(F.pmod(eid, F.lit(2)) == 0, F.concat(
        F.lit("Actual model size (total parameters): "), py_float_str_sql("value / 10.0D"), F.lit("M"))).otherwise(
        F.concat(F.lit("Train dataset length: "), (v * F.lit(100.0)).cast("bigint").cast("string"),
                 F.lit(", Test dataset length: 200")))
    loss = F.concat(F.rpad(F.when(F.pmod(eid, F.lit(2)) == 0, F.lit("Train Loss")).otherwise(F.lit("Test Loss")), 40, " "),
                    F.when(v > 340, F.lit("nan")).otherwise(py_float_str_sql("value / 100.0D")))
    body = (F.when(F.col("event_type") == "view", namespace).when(F.col("event_type") == "click", acc)
            .when(F.col("event_type") == "purchase", r2).when(F.col("event_type") == "signup", size).otherwise(loss))
    return e.select(
        "event_id", path.alias("path"),
        F.struct(F.col("ts").alias("t"), eid.alias("e")).alias("line_no"),   # time order, zone-independent
        F.concat(prefix, body).alias("line"))


def run_log_lines_sql() -> str:
    methods = ", ".join(f"'{m}'" for m in LOG_METHODS)
    accs = ", ".join(f"'{a}'" for a in ACC_NAMES)
    periods = ", ".join(f"'{p}'" for p in PERIOD_LISTS)
    return f"""lines AS (
  SELECT event_id,
         concat_ws('/', 'result/add', CASE WHEN user_id % 5 = 0 THEN 'pretrained' ELSE 'scratch' END, method,
                   'run' || CAST(user_id AS VARCHAR) || '_addlinear_' || CASE WHEN user_id % 3 = 0 THEN 'True' ELSE 'False' END
                   || '_usedigitwisetokenizer_' || CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'False' END,
                   'training_log_' || strftime(ts, '%Y%m%d') || '.log') AS path,
         {{'t': ts, 'e': event_id}} AS line_no,
         strftime(ts, '%Y-%m-%d %H:%M:%S') || ' - INFO - ' || CASE event_type
           WHEN 'view' THEN 'Namespace(batch_size=512, model=''org/model-' || CAST(user_id % 3 AS VARCHAR)
                || ''', num_train_samples=' || CASE WHEN event_id % 13 = 0 THEN 'None' ELSE CAST(100 * (1 << (event_id % 12)) AS VARCHAR) END
                || CASE WHEN method <> 'regular' THEN ', period_base_list=[' || [{periods}][event_id % 3 + 1] || ']' ELSE '' END
                || ', epochs=100)'
           WHEN 'click' THEN rpad([{accs}][event_id % 3 + 1], 40, ' ') || CAST(least(value, 100.0::DOUBLE) AS VARCHAR) || '%'
           WHEN 'purchase' THEN rpad('R^2', 40, ' ') || CAST(1.0::DOUBLE - value / 400.0::DOUBLE AS VARCHAR)
           WHEN 'signup' THEN CASE WHEN event_id % 2 = 0
                THEN 'Actual model size (total parameters): ' || CAST(value / 10.0::DOUBLE AS VARCHAR) || 'M'
                ELSE 'Train dataset length: ' || CAST(CAST(trunc(value * 100.0::DOUBLE) AS BIGINT) AS VARCHAR) || ', Test dataset length: 200' END
           ELSE rpad(CASE WHEN event_id % 2 = 0 THEN 'Train Loss' ELSE 'Test Loss' END, 40, ' ')
                || CASE WHEN value > 340 THEN 'nan' ELSE CAST(value / 100.0::DOUBLE AS VARCHAR) END
         END AS line
  FROM (SELECT *, [{methods}][user_id % 4 + 1] AS method FROM events))"""
