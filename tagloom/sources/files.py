"""Sources and sinks: Parquet, JSON lines (plain and gzip), single JSON documents, sidecars, reports, batch files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzip; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def scan_numbered_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON-lines file with row_id, the line's ordinal. Order is known within one file only, so several files are refused."""
    if len(spark.read.text(path).inputFiles()) > 1:
        raise ValueError("line numbers need a single file; give several files an explicit row_id")
    lines = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1], x[0][0])).toDF("row_id bigint, value string")
    parsed = lines.where(F.trim("value") != "").select("row_id", F.from_json("value", schema).alias("v"))
    return parsed.select("row_id", *[F.col(f"v.{f}") for f in T.StructType.fromDDL(schema).names if f != "row_id"])


def scan_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """.jsonl as lines, anything else as one JSON document that is an object or a list."""
    return scan_json_lines(spark, path, schema) if path.endswith(".jsonl") else spark.read.schema(schema).option("multiLine", True).json(path)


def first_rows(df: DataFrame, n: int, key: str = "row_id") -> DataFrame:
    return df.where(F.col(key) < n)


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources under one schema, with source."""
    out = None
    for name, df in sources.items():
        named = df.withColumn("source", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


def write_json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """UTF-8 JSON lines with null fields kept; task commits make the output atomic."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).text(path)


def write_sidecar(spark: SparkSession, document: dict, path: str) -> None:
    """A small JSON document, such as statistics, metrics or run meta data, as a one-line text file beside the output."""
    spark.createDataFrame([(json.dumps(document, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str, model: str, mode: str = "error") -> None:
    """Predictions of a model under its name with / as _; a failed row has an empty output and its error."""
    shaped = df.select("row_id", F.coalesce("output", F.lit("")).alias("output"), "error")
    write_json_lines(shaped, f"{path}/{model.replace('/', '_')}_preds", mode)
