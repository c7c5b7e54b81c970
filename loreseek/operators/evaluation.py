"""Retrieval metrics over ranked matches, all cases at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_metrics(cases: DataFrame, matches: DataFrame) -> DataFrame:
    """(case_id, retrieved, precision, recall, reciprocal_rank, first_relevant_rank) of each case.

    cases: case_id, expected_paths. matches: case_id, rank (from 1), paths. A match is relevant if any of its
    paths is expected. Precision divides by what was retrieved (0 if nothing); recall counts distinct expected
    paths (1 if none is expected).
    """
    expected = cases.select("case_id", F.array_distinct("expected_paths").alias("expected"))
    judged = matches.join(expected, "case_id").select("case_id", "rank", F.array_intersect("paths", "expected").alias("found"))
    relevant = F.size("found") > 0
    summed = judged.groupBy("case_id").agg(
        F.count("*").alias("retrieved"),
        F.count_if(relevant).alias("relevant"),
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("distinct_found"),
        F.min(F.when(relevant, F.col("rank"))).alias("first"),
    )
    joined = expected.join(summed, "case_id", "left")
    retrieved = F.coalesce("retrieved", F.lit(0))
    wanted = F.size("expected")
    return joined.select(
        "case_id",
        retrieved.cast("long").alias("retrieved"),
        F.when(retrieved == 0, F.lit(0.0)).otherwise(F.col("relevant") / F.col("retrieved")).alias("precision"),
        F.when(wanted == 0, F.lit(1.0)).otherwise(F.coalesce("distinct_found", F.lit(0)) / F.greatest(wanted, F.lit(1))).alias("recall"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.col("first").cast("long").alias("first_relevant_rank"),
    )


def report(metrics: DataFrame) -> DataFrame:
    """One row: cases, and the unweighted means (0 without cases)."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return metrics.agg(F.count("*").alias("cases"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"))


def least_coverage(runs: DataFrame) -> DataFrame:
    """One row of ``runs`` (case_id, embedded, known, degraded): the first least covered case's counts, and whether any was degraded."""
    fraction = F.when(F.col("known") == 0, F.lit(0.0)).otherwise(F.col("embedded") / F.greatest("known", F.lit(1)))
    least = F.min_by(F.struct("embedded", "known"), F.struct(fraction, F.col("case_id")))
    zero = F.lit(0).cast("long")
    return runs.agg(least.alias("c"), F.coalesce(F.bool_or("degraded"), F.lit(False)).alias("any_degraded")).select(F.coalesce("c.embedded", zero).alias("embedded"), F.coalesce("c.known", zero).alias("known"), "any_degraded")
