"""Exact cosine search over quantised vectors, one hit a blob (its best chunk)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreseek.functions.vectors import cosine_quantized, literal

BLOCK = 256  # queries that a scan answers at once


def sound(vectors: DataFrame, dimensions: int) -> DataFrame:
    """Without records that can't be compared with a query of so many dimensions: a wrong length, a null, or limits that are no numbers."""
    whole = (F.size("q_data") == dimensions) & ~F.exists("q_data", lambda x: x.isNull())
    return vectors.filter(whole & (F.abs("q_min") < float("inf")) & (F.abs("q_scale") < float("inf")))


def search(vectors: DataFrame, query: Sequence[float] | Column, top_k: int, candidates: DataFrame | None = None) -> DataFrame:
    """(blob_hash, score) of the ``top_k`` best blobs of ``vectors`` (blob_hash, q_min, q_scale, q_data).

    candidates (blob_hash) are filtered before scoring. The maximum combines map-side, and order with limit
    keeps top_k rows a task.
    """
    if not isinstance(query, Column):
        vectors = sound(vectors, len(query))
    if candidates is not None:
        vectors = vectors.join(candidates, "blob_hash", "left_semi")
    asked = query if isinstance(query, Column) else literal(query)
    scored = vectors.select("blob_hash", cosine_quantized(asked, F.col("q_min"), F.col("q_scale"), F.col("q_data")).alias("score"))
    best = scored.groupBy("blob_hash").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "blob_hash").limit(max(0, top_k))


def search_many(vectors: DataFrame, queries: list[tuple[int, Sequence[float]]], top_k: int, candidates: DataFrame | None = None) -> DataFrame:
    """(query_id, blob_hash, score) of the best blobs of each query.

    Queries go in blocks of fixed size; a task reduces its vectors to top_k blobs a query, by products of an
    Arrow batch with one query after the other (in the index's single precision), so what is shuffled doesn't grow with the vectors. A blob that is among
    the best of all is among the best of the task that holds its best chunk.
    """
    from loreseek.operators.fts import best

    if queries:
        vectors = sound(vectors, len(queries[0][1]))
    if candidates is not None:
        vectors = vectors.join(candidates, "blob_hash", "left_semi")
    source = vectors.select("blob_hash", "q_min", "q_scale", "q_data")
    shape = "query_id long, blob_hash string, score double"
    parts = [source.mapInArrow(_scorer(queries[at : at + BLOCK], top_k), shape) for at in range(0, len(queries), BLOCK)]
    if not parts:
        return vectors.sparkSession.createDataFrame([], shape)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    merged = found.groupBy("query_id", "blob_hash").agg(F.max("score").alias("score"))
    return best(merged, top_k, "score", descending=True)


def _scorer(queries: list[tuple[int, Sequence[float]]], top_k: int):
    ids = np.array([q for q, _ in queries], np.int64)
    asked = np.array([v for _, v in queries], np.float32)
    asked_length = np.sqrt((asked.astype(np.float64) ** 2).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, float]] = [{} for _ in ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_pylist()
            low, scale = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float32)[:, None] for k in (1, 2))
            levels = np.asarray(batch.column(3).flatten()).astype(np.int32).reshape(batch.num_rows, -1)
            vectors = (levels + 128).astype(np.float32) * scale + low
            own = np.sqrt((vectors * vectors).sum(axis=1, dtype=np.float64))
            for n in range(len(ids)):
                length = own * asked_length[n]
                dot = (vectors * asked[n]).sum(axis=1, dtype=np.float64)
                score = np.divide(dot, length, out=np.zeros_like(dot), where=length > 0)
                kept = held[n]
                floor = min(kept.values()) if len(kept) >= top_k else -np.inf
                for k in np.flatnonzero(score >= floor).tolist():
                    kept[names[k]] = max(kept.get(names[k], -np.inf), float(score[k]))
                if len(kept) > top_k:
                    held[n] = dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:top_k])
        rows = [(int(q), name, score) for q, kept in zip(ids, held, strict=True) for name, score in kept.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.float64()), strict=True)], names=["query_id", "blob_hash", "score"])

    return run
