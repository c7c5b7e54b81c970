"""The context-limit chain: the whole text, then windows of 1500, then of 800, then failure.

At each size a text counts only if all its chunks embed; nothing of a failed
size is kept. Each stage is written before it is split, so no text is embedded
twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreseek.functions.chunking import OVERLAP, Chunker, FixedChunker, chunks
from loreseek.functions.embedding import CONTEXT, Provider, embed
from loreseek.schemas import WHOLE_FILE
from loreseek.sources.shared import bound_batches

SIZES = (1500, 800)
Keep = Callable[[DataFrame, str], DataFrame]


def embed_with_fallback(texts: DataFrame, provider: Provider, keep: Keep, batch_size: int = 1, concurrency: int = 4, chunker: Chunker | None = None, sizes: tuple[int, ...] = SIZES) -> tuple[DataFrame, DataFrame]:
    """(vectors, failed) of ``texts`` (blob_hash, content).

    vectors: blob_hash, chunk_index (-1: whole text), vector. failed: blob_hash, error. ``keep`` writes a frame
    under a name and reads it back. A chunker makes the first text (its first chunk; default: the whole file).
    """
    bound_batches(texts.sparkSession)
    first = texts if chunker is None else texts.select("blob_hash", chunks(F.col("content"), chunker)[0]["content"].alias("content"))
    whole = keep(first.repartition(concurrency).select("blob_hash", embed(F.col("content"), provider, batch_size).alias("e")), "whole")
    done = [whole.filter("e.error is null").select("blob_hash", F.lit(WHOLE_FILE).alias("chunk_index"), F.col("e.vector").alias("vector"))]
    failed = [whole.filter((F.col("e.error").isNotNull()) & (F.col("e.error") != CONTEXT)).select("blob_hash", F.col("e.error").alias("error"))]
    # The chain cuts the text that was tried first.
    rest = first.join(whole.filter(F.col("e.error") == CONTEXT).select("blob_hash"), "blob_hash", "left_semi")
    for size in sizes:
        cut = rest.select("blob_hash", F.posexplode(chunks(F.col("content"), FixedChunker(size, OVERLAP))).alias("chunk_index", "chunk"))
        tried = keep(cut.repartition(concurrency).select("blob_hash", "chunk_index", embed(F.col("chunk.content"), provider, batch_size).alias("e")), f"fixed-{size}")
        whole_blob = tried.groupBy("blob_hash").agg(F.bool_and(F.col("e.error").isNull()).alias("ok"))
        done.append(tried.join(whole_blob.filter("ok"), "blob_hash", "left_semi").select("blob_hash", "chunk_index", F.col("e.vector").alias("vector")))
        rest = rest.join(whole_blob.filter("not ok").select("blob_hash"), "blob_hash", "left_semi")
    failed.append(rest.select("blob_hash", F.lit(CONTEXT).alias("error")))
    vectors = done[0]
    for part in done[1:]:
        vectors = vectors.union(part)
    return vectors, failed[0].union(failed[1])
