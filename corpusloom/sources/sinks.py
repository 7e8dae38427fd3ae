"""Sinks: JSON lines, JSON with a summary beside it, Parquet by split, batches, metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """UTF-8 JSON lines. An existing target is an error unless overwrite is set; commits are atomic a job."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def write_with_summary(rows: DataFrame, summary: DataFrame, path: str, overwrite: bool = False) -> None:
    write_jsonl(rows, f"{path}/items", overwrite)
    write_jsonl(summary, f"{path}/summary", overwrite)


def write_splits(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet, one folder a split."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("split").parquet(path)


def manifest(rows: DataFrame) -> DataFrame:
    """A one-row table as one JSON text."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("manifest"))


def save_batch(rows: DataFrame, meta: dict, path: str) -> None:
    """Columns as Parquet, meta information beside them."""
    rows.write.parquet(f"{path}/columns")
    rows.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.json(f"{path}/meta")


def load_batch(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    meta = spark.read.schema("meta string").json(f"{path}/meta").first().meta
    return spark.read.parquet(f"{path}/columns"), json.loads(meta)


LOGGERS = {}


def logger(name: str):
    """Register a metrics logger: a function of (spark, step, metrics, path)."""

    def add(f):
        LOGGERS[name] = f
        return f

    return add


@logger("parquet")
def log_metrics(spark: SparkSession, step: int, metrics: dict[str, float], path: str) -> None:
    """Append (step, key, value) rows to a metrics table."""
    rows = [(step, k, float(v)) for k, v in sorted(metrics.items())]
    spark.createDataFrame(rows, "step long, key string, value double").coalesce(1).write.mode("append").parquet(path)


@logger("console")
def print_metrics(spark: SparkSession, step: int, metrics: dict[str, float], path: str = "") -> None:
    print(f"step {step}", *(f"{k}={v}" for k, v in sorted(metrics.items())))
