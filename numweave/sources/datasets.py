"""Split datasets: CSV sink (one directory per split, header) and the
loader that falls back to a seeded train/test split (inventory 2.1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.split import split_random

QA_SCHEMA = "question string, label double"
INTEGER_QA_SCHEMA = "question string, label bigint"


def sink_split_csv(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """train / validation / test as ``split=<name>/part-*.csv`` with a header
    line and no index column. Each split is written by many tasks in
    parallel (no single-file coalesce)."""
    df.write.mode(mode).partitionBy(split_col).option("header", True).csv(path)


def src_split_dataset(spark: SparkSession, path: str, schema: str = QA_SCHEMA, key_cols=("question",),
                      split_col: str = "split") -> DataFrame:
    """Load every split below ``path`` (declared schema, no inference); when
    no ``test`` split exists, carve a seeded 10 % test split out of train.
    Labels are doubles unless the caller declares integers; a value that does
    not fit the schema fails the read instead of turning into NULL. Looking for
    the test split starts one small job."""
    df = spark.read.schema(f"{schema}, {split_col} string").option("header", True).option("mode", "FAILFAST").csv(path)
    has_test = df.filter(F.col(split_col) == "test").limit(1).count() > 0
    if has_test:
        return df
    train = df.filter(F.col(split_col) == "train").drop(split_col)
    return split_random(train, list(key_cols), out=split_col)
