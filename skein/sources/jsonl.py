"""Documents as JSON lines: `{"id": str, "vector": [float], "metadata": {...}?, "text": str?}`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_documents(lines: DataFrame, column: str = "value") -> DataFrame:
    """`(id, vector, metadata, text)` of lines; blank ones are passed over. A line that is no JSON fails the job; one
    without id or vector has null there, which validation refuses."""
    v = lines.where(F.trim(column) != "").select(F.parse_json(column).alias("v"))
    return v.select(
        F.try_variant_get("v", "$.id", "string").alias("id"),
        F.try_variant_get("v", "$.vector", "array<float>").alias("vector"),
        F.try_variant_get("v", "$.metadata", "variant").alias("metadata"),
        F.try_variant_get("v", "$.text", "string").alias("text"),
    )


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse_documents(spark.read.text(path))


def write_jsonl(docs: DataFrame, path: str) -> None:
    """The inverse of `read_jsonl`: one JSON object a line."""
    docs.select(F.to_json(F.struct("id", "vector", "metadata", "text")).alias("value")).write.text(path)
