"""Follows a history: new commits arrive as micro-batches and are indexed.

The stream's offset names the heads of what was read, so its checkpoint is the
resume cursor. Batches may come twice after a failure; all writes ignore keys
that are there, so they count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loreseek.plans.index import HistoryIndex
from loreseek.sources.git import register


def commit_stream(spark: SparkSession, path: str, ref: str = "HEAD", since: str | None = None, max_commits: int | None = None) -> DataFrame:
    register(spark)
    options = {"kind": "commits", "path": path, "ref": ref, "since": since or ""} | ({"maxcommits": str(max_commits)} if max_commits else {})
    return spark.readStream.format("githistory").options(**options).load()


def follow(index: HistoryIndex, path: str, checkpoint: str, ref: str = "HEAD", *, blobs: bool = True, once: bool = True, max_commits: int | None = None, listener: Callable[[int, int], None] = lambda batch, commits: None) -> StreamingQuery:
    """Starts the stream. once: take what there is, batch by batch, and return when it has stopped; otherwise look for new commits every ten seconds.

    blobs: index the contents that a batch's commits brought in, too. listener is told each batch's number and commits.
    """

    def take(batch: DataFrame, number: int) -> None:
        if blobs:
            count = index.index_changes(batch, ref).commits
        else:
            count = batch.count()
            index.register_commits(batch)
        listener(number, count)

    writer = commit_stream(index.spark, path, ref, max_commits=max_commits).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    query = writer.trigger(processingTime="0 seconds" if once else "10 seconds").start()
    if once:
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return query
