"""Hybrid search: vector leg and keyword leg in one plan, then blend and ranking of what they found.

Each leg leaves at most an over-fetch of rows a query. These candidates are written
as a small table, so that paths and commits are looked up without running the legs
again; its size on disk, which the planner knows, decides whether it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loreseek.functions.scores import BM25_WEIGHT, Weights, blend, min_max, recency, three_signal
from loreseek.functions.text import best_path_relevance
from loreseek.operators import fts
from loreseek.operators.relational import first_seen, paths_for
from loreseek.sources.shared import Scratch

OVER_FETCH, LEAST_FETCH = 3, 50


def _pool() -> WindowSpec:
    """One query's candidates."""
    return Window.partitionBy("query_id")


def over_fetch(top_k: int, multiplier: int = OVER_FETCH, least: int = LEAST_FETCH) -> int:
    """How many hits each leg gives: pools, and so all normalised scores, depend on it."""
    return max(top_k * multiplier, least)


def _of(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows of the candidates."""
    return rows.join(candidates.select("blob_hash").distinct(), "blob_hash", "left_semi")


def _written(rows: DataFrame, name: str) -> DataFrame:
    """Rows that a fetch limit for each query bounds, computed once."""
    return Scratch(rows.sparkSession, "search").table(rows, name)


def keyword_only(fts_hits: DataFrame, path_entry: DataFrame, top_k: int, branch: DataFrame | None = None) -> DataFrame:
    """Degraded search. fts_hits: query_id, blob_hash, bm25, cut to the fetch limit already; the branch filters after that limit."""
    if branch is not None:
        fts_hits = fts_hits.join(branch, "blob_hash", "left_semi")
    scored = fts_hits.select("query_id", "blob_hash", min_max(-F.col("bm25"), _pool()).alias("score"))
    kept = _written(fts.best(scored, top_k, "score", descending=True), "kept")
    paths = paths_for(_of(path_entry, kept))
    return _matches(kept.join(paths, "blob_hash", "left"), "FTS", True)


def hybrid(queries: DataFrame, vector_hits: DataFrame, fts_hits: DataFrame, path_entry: DataFrame, blob_commit: DataFrame, commits: DataFrame, top_k: int, branch: DataFrame | None = None, weights: Weights = Weights(), bm25_weight: float = BM25_WEIGHT) -> DataFrame:
    """Matches of each query. queries: query_id, text. vector_hits: query_id, blob_hash, score (filtered by branch before their limit).

    fts_hits: query_id, blob_hash, bm25 (filtered by branch here, after their limit). Missing sides count 0;
    recency counts only where all candidates of a query have a first commit.
    """
    if branch is not None:
        fts_hits = fts_hits.join(branch, "blob_hash", "left_semi")
    vector = vector_hits.select("query_id", "blob_hash", min_max(F.col("score"), _pool()).alias("v"))
    keyword = fts_hits.select("query_id", "blob_hash", min_max(-F.col("bm25"), _pool()).alias("b"))
    pool = vector.join(keyword, ["query_id", "blob_hash"], "full_outer").select("query_id", "blob_hash", blend(F.col("v"), F.col("b"), bm25_weight).alias("blended"))
    pool = _written(pool, "pool")
    paths = paths_for(_of(path_entry, pool))
    seen = first_seen(_of(blob_commit, pool), commits)
    full = pool.join(queries.select("query_id", "text"), "query_id").join(paths, "blob_hash", "left").join(seen, "blob_hash", "left")
    signals = full.select("query_id", "blob_hash", "paths", "blended", recency(F.col("first_seen"), _pool()).alias("recent"), best_path_relevance(F.col("text"), F.col("paths")).alias("relevance"))
    scored = signals.select("query_id", "blob_hash", "paths", three_signal(F.col("blended"), F.col("recent"), F.col("relevance"), weights).alias("score"))
    return _matches(fts.best(scored, top_k, "score", descending=True), "HYBRID", False)


def _matches(rows: DataFrame, provenance: str, degraded: bool) -> DataFrame:
    """The rows of a result; spans are placeholders, files being indexed whole."""
    rank = F.row_number().over(_pool().orderBy(F.desc("score"), "blob_hash")).cast("int")
    return rows.select("query_id", rank.alias("rank"), "blob_hash", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "score", F.lit(provenance).alias("provenance"), F.lit(degraded).alias("degraded"))
