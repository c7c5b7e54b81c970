"""Evaluation cases: one JSON object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(query, expected_paths) of each usable line: blank lines, # and // comments, malformed lines and lines without a query are passed over."""
    line = F.trim(F.col("value"))
    kept = spark.read.text(path).filter((line != "") & ~line.startswith("#") & ~line.startswith("//"))
    parsed = kept.select(F.from_json(line, "query string, expectedPaths array<string>", {"mode": "PERMISSIVE"}).alias("c"))
    cases = parsed.filter(F.col("c.query").isNotNull())
    return cases.select(F.col("c.query").alias("query"), F.array_distinct(F.coalesce("c.expectedPaths", F.array().cast("array<string>"))).alias("expected_paths"))


