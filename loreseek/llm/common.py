"""Arrow helpers, joins of hot keys and connected components for the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreseek.sources.shared import Scratch

#: A character of a word: anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names for added columns that no column of ``docs`` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated UTF-8 bytes of a string column and its n + 1 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text each, so that memory follows the limit, not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


#: Rows of one key that a join may bring to one task.
HOT = 100_000
#: Links that one task may hold; more are contracted by many tasks first.
LOCAL = 1 << 18


def join_hot(rows: DataFrame, one: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """``rows`` (a written table) joined with ``one`` (a written table with a row and the number ``n`` of rows a key).

    The rows of a key with more than ``hot`` of them meet a broadcast row and stay where they are: of such keys
    there are at most rows / hot. The others are shuffled as usual.
    """
    often = one.filter(F.col("n") > hot).drop("n")
    if often.isEmpty():
        return rows.join(one.drop("n"), key)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(one.filter(F.col("n") <= hot).drop("n"), key)
    return rows.join(F.broadcast(often), key).unionByName(rest)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) from all links: each root is hung below the smallest root that it has a link to, until none has one."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    nodes, places = np.unique(np.concatenate([*(u for u, _ in held), *(v for _, v in held)]), return_inverse=True)
    u, v = places.reshape(2, -1)
    root = np.arange(len(nodes))
    while (apart := root[u] != root[v]).any():
        u, v = root[u[apart]], root[v[apart]]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while ((after := root[root]) != root).any():
            root = after
    for at in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(nodes[root[at : at + (1 << 16)]])], names=["node", "root"])


def connected_components(edges: DataFrame, scratch: Scratch, hot: int = HOT, local: int = LOCAL) -> DataFrame:
    """(node, root) of every node of ``edges`` (u long, v long); root is the smallest node reachable.

    Up to ``local`` links are finished by one task, without further tables.
    More of them go through alternating large-star and small-star contraction: each round is two
    aggregations with map-side combine and two joins, in which the links of a
    node that has very many stay in their tasks (``join_hot``), so no task
    gathers a component, and the driver holds no links. Rounds grow with the
    logarithm of the longest chain.
    """
    now = scratch.table(_ordered(edges), "edges-0")
    many, before, rounds = now.count(), None, 0
    while many > local:
        rounds += 1
        both = scratch.table(now.union(now.select("v", "u")), f"both-{rounds}")
        low = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), f"low-{rounds}")
        large = join_hot(both.filter("v > u"), low, "u", hot).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(_ordered(large), f"large-{rounds}")
        least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"least-{rounds}")
        small = join_hot(large, least, "u", hot)
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = scratch.table(_ordered(after), f"edges-{rounds}")
        for old in (f"edges-{rounds - 1}", f"both-{rounds}", f"low-{rounds}", f"large-{rounds}", f"least-{rounds}"):
            scratch.drop(old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        many, before = state[0], state
    return now.coalesce(1).mapInArrow(_finished, "node long, root long")


def _ordered(edges: DataFrame) -> DataFrame:
    """Each link once, larger end first, without loops."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
