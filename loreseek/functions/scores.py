"""Scores that depend on a whole pool of candidates: normalisation, blending, recency, ranking.

A pool is a window partition: one query's candidates. Pools are as large as an
over-fetch limit, never as large as the index.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

BM25_WEIGHT = 0.3


@dataclass(frozen=True)
class Weights:
    vector: float = 0.7
    recency: float = 0.2
    path: float = 0.1


def min_max(value: Column, pool: WindowSpec) -> Column:
    """0 to 1 over the pool; 0.5 where all values are equal; null stays null."""
    low, high = F.min(value).over(pool), F.max(value).over(pool)
    return F.when(value.isNull(), F.lit(None)).when(high == low, F.lit(0.5)).otherwise((value - low) / (high - low))


def min_max_by(rows: DataFrame, value: str, pool: list[str], name: str) -> DataFrame:
    """``rows`` with ``min_max`` of a column over pools of any size: limits are aggregated with map-side combine and joined, so no task holds a pool."""
    limits = rows.groupBy(*(F.col(p).alias(f"_p{k}") for k, p in enumerate(pool))).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    same = reduce(lambda a, b: a & b, (F.col(p).eqNullSafe(F.col(f"_p{k}")) for k, p in enumerate(pool)))
    at = F.col(value)
    scaled = F.when(at.isNull(), F.lit(None)).when(F.col("_high") == F.col("_low"), F.lit(0.5)).otherwise((at - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return rows.join(limits, same).select(*rows.columns, scaled.alias(name))


def blend(vector: Column, keyword: Column, weight: float = BM25_WEIGHT) -> Column:
    """Normalised scores of both legs; a missing side counts 0."""
    return F.lit(1 - weight) * F.coalesce(vector, F.lit(0.0)) + F.lit(weight) * F.coalesce(keyword, F.lit(0.0))


def recency(first_seen: Column, pool: WindowSpec) -> Column:
    """0 (oldest) to 1 (newest) over the pool, 1 where all are equal; null for all if any is unknown."""
    known = F.count(first_seen).over(pool) == F.count(F.lit(1)).over(pool)
    low, high = F.min(first_seen).over(pool), F.max(first_seen).over(pool)
    return F.when(known & (high == low), F.lit(1.0)).when(known, (first_seen - low) / (high - low))


def three_signal(score: Column, recent: Column, path: Column, weights: Weights = Weights()) -> Column:
    """Weighted mean; without recency its weight leaves the denominator, too."""
    fresh = F.when(recent.isNull(), F.lit(0.0)).otherwise(F.lit(weights.recency))
    total = F.lit(weights.vector) + fresh + F.lit(weights.path)
    sum_ = F.lit(weights.vector) * score + fresh * F.coalesce(recent, F.lit(0.0)) + F.lit(weights.path) * path
    return sum_ / F.when(total == 0, F.lit(1.0)).otherwise(total)


def coverage_fraction(embedded: Column, known: Column) -> Column:
    return F.when(known == 0, F.lit(0.0)).otherwise(embedded / F.when(known == 0, F.lit(1)).otherwise(known))


def coverage_complete(embedded: Column, known: Column) -> Column:
    return (known > 0) & (embedded >= known)
