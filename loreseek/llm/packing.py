"""Conflict-constrained best-fit packing of documents into sequences.

A document of more than ``CAPACITY`` words is cut: its full pieces fill bins
alone, and its last piece is packed like a short document. Two pieces conflict
if their documents belong to one duplicate cluster, or if their sources are a
pair that must not be mixed. Open bins are kept by residual capacity with a
bitmap of the residuals in use; each bin carries a bitmap of its sources and a
bitmap of its duplicate clusters. A piece (largest first) goes to the tightest
compatible bin: the search steps from residual to successor until one is found,
and opens a new bin only if there is none.

Documents are dealt to shards by a hash of id and text, about ``SHARD`` pieces
each, and shards are packed independently: a shard's size is bounded, copies and
hot sources spread over all shards, and each shard leaves at most a few loose
bins. Rows that are equal in all that counts are one row with a number until
they are dealt, ``TOGETHER`` of them to a shard and the next ones to the next
shard, so a hot row spreads as well, and bins depend on the rows only, not on
how they lie in files. Only ids, sizes, sources and cluster names move, never
texts.

Defined results: a null or wordless text has one piece of size 0, which fits
anywhere that its conflicts allow; a null source is a source; rows with a null
cluster conflict with nothing; equal rows are packed one by one (and, as copies
of one cluster, apart); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreseek.llm.mixing import words

CAPACITY = 2048
SHARD = 8192
TOGETHER = 64


class Bins:
    """Open bins by residual capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.used = capacity, 0  # used: a bitmap of residuals
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, against: int, cluster: int) -> int:
        """The bin that takes a piece. source, cluster: its bits; against: the bits of sources it conflicts with."""
        rest = self.used >> size
        residual = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            residual += step
            row = self.at[residual]
            for k in range(len(row) - 1, -1, -1):
                b = row[k]
                if not self.sources[b] & against and not self.clusters[b] & cluster:
                    row[k] = row[-1]
                    row.pop()
                    if not row:
                        self.used &= ~(1 << residual)
                    return self._put(b, residual - size, source, cluster)
            rest >>= step + 1
            residual += 1
        self.sources.append(0)
        self.clusters.append(0)
        return self._put(len(self.sources) - 1, self.capacity - size, source, cluster)

    def _put(self, b: int, residual: int, source: int, cluster: int) -> int:
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.at[residual].append(b)
        self.used |= 1 << residual
        return b


def pack(pieces: Iterable[tuple[int, str | None, int | None]], capacity: int = CAPACITY, apart: Iterable[tuple[str, str]] = ()) -> list[int]:
    """The bin of each (size, source, cluster), in the order given; sizes don't exceed the capacity."""
    rows = list(pieces)
    sources = {s: 1 << k for k, s in enumerate(dict.fromkeys(r[1] for r in rows))}
    against = defaultdict(int)
    for a, b in apart:
        against[a] |= sources.get(b, 0)
        against[b] |= sources.get(a, 0)
    seen: dict[int, int] = defaultdict(int)
    for _, _, cluster in rows:
        seen[cluster] += 1
    shared = {c: 1 << k for k, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}  # only these can conflict
    bins, out = Bins(capacity), [0] * len(rows)
    for k in sorted(range(len(rows)), key=lambda k: (-rows[k][0], k)):
        size, source, cluster = rows[k]
        out[k] = bins.place(size, sources[source], against.get(source, 0), shared.get(cluster, 0))
    return out


def cluster_of(text: Column) -> Column:
    """The cluster of exact copies, up to ASCII case; an empty text belongs to none."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(text) > 0, F.xxhash64(lowered))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, apart: Iterable[tuple[str, str]] = (), cluster: Column | None = None) -> DataFrame:
    """(doc_id, source, size, piece, start, words, shard, bin, full) of each piece of ``docs`` (doc_id, text, source).

    start, words: the piece's place in the document's words. A bin is named by shard and bin; a full
    piece has a bin of its own, numbered below zero. apart: pairs of sources that must
    not share a bin. cluster: a long that names the duplicate cluster (default: exact copies, up to ASCII case).
    """
    spark = docs.sparkSession
    count = docs.count()
    shards = max(1, -(-count // shard))
    size = words(F.col("text"))
    name = cluster if cluster is not None else cluster_of(F.col("text"))
    salt = F.coalesce(F.xxhash64("doc_id", "text"), F.lit(0))
    narrow = docs.select("doc_id", "source", size.alias("size"), name.alias("cluster"), salt.alias("salt"))
    # Equal rows are counted map-side; their copies are dealt by rank, and it doesn't matter which row has which.
    equal = narrow.groupBy("doc_id", "source", "size", "cluster", "salt").agg(F.count("*").alias("many"))
    chunks = equal.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / TOGETHER))))
    narrow = chunks.select("doc_id", "source", "size", "cluster", F.pmod(F.pmod("salt", F.lit(shards)) + F.col("chunk"), F.lit(shards)).cast("int").alias("shard"), F.least(F.lit(TOGETHER), F.col("many") - F.col("chunk") * TOGETHER).cast("int").alias("times"))
    apart = tuple(apart)
    out = "doc_id long, source string, size long, piece int, start long, words long, shard int, bin long, full boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for *row, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held += [tuple(row)] * times
            while held and held[0][0] != held[-1][0]:
                cut = next(k for k, r in enumerate(held) if r[0] != held[0][0])
                yield from packed(held[:cut])
                held = held[cut:]
        if held:
            yield from packed(held)

    def packed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rest = [(n - (n - 1) // capacity * capacity if n else 0, source, cluster) for _, _, source, n, cluster in rows]
        bins = pack(rest, capacity, apart)
        made, alone = [], 0
        for (number, doc_id, source, n, _), (last, _, _), b in zip(rows, rest, bins, strict=True):
            whole = (n - last) // capacity
            for k in range(whole):
                alone -= 1
                made.append((doc_id, source, n, k, k * capacity, capacity, number, alone, True))
            made.append((doc_id, source, n, whole, whole * capacity, last, number, b, False))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
        names = ["doc_id", "source", "size", "piece", "start", "words", "shard", "bin", "full"]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    tasks = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = narrow.select("shard", "doc_id", "source", "size", "cluster", "times").repartition(tasks, "shard")
    return dealt.sortWithinPartitions("shard", "doc_id", "size", "source", "cluster").mapInArrow(run, out)
