"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are computed in one pass over the texts. Only distinct
fingerprints are compared, so exact copies never meet. Two fingerprints that
differ in at most ``RADIUS`` = 3 of 64 bits agree in full on one of four 16-bit
blocks (pigeonhole), so each distinct fingerprint is dealt under its four
blocks. A key's fingerprints are sorted by population count and cut into tiles;
tile is compared with tile by numpy exclusive-or and bit counts, and pairs of
tiles whose population counts lie further apart than the radius are skipped.
Small keys share a tile. A tile pair emits a spanning forest of its links, never
all pairs; connected components follow by distributed star contraction, which
one task finishes once few links are left.

Keys with more than ``SPLIT`` fingerprints are dealt anew under four blocks of
12 of the other bits (the same principle), and what is still larger is cut into
parts by hash, each pair of parts being a group of its own: no task holds an
unbounded group and no link is lost. The lists of such keys have at most four,
or sixteen, rows for each ``SPLIT`` fingerprints.

Defined results: a null or wordless text has fingerprint zero and links like any
other; rows with a null id keep their fingerprint and get the smallest id of
their component (null if it has none); repeated rows are returned once each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreseek.llm import nearcopies
from loreseek.llm.common import connected_components, pieces, unused
from loreseek.sources.shared import Scratch

RADIUS = 3
TILE = 512
SPLIT = 16384


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of the shingles' hashes."""
    found = text.lower().split()  # bytes: A-Z only, and white space is x20 and x09-x0D
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            texts = batch.column(1).to_pylist()
            out = np.fromiter((fingerprint((t or "").encode()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _keys(fp: Column) -> Column:
    """The four keys of a fingerprint: the block's number, then its bits."""
    return F.array(*[F.lit(n << 32).bitwiseOR(F.shiftrightunsigned(fp, 16 * n).bitwiseAND(F.lit(0xFFFF))) for n in range(4)])


def _finer(fp: Column, key: Column) -> Column:
    """The four keys below a key: the key, the number of a 12-bit block of the other 48 bits, and its bits."""
    at = F.shiftright(key, 32).cast("int") * 16  # first bit of the key's block
    low = fp.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at) - 1)
    high = F.when(at == 48, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.call_function("shiftrightunsigned", fp, at + 16), at))
    rest = low.bitwiseOR(high)
    named = F.lit(1 << 40).bitwiseOR(F.shiftleft(key, 16))  # above all coarse keys
    return F.array(*[named.bitwiseOR(F.lit(n << 12)).bitwiseOR(F.shiftrightunsigned(rest, 12 * n).bitwiseAND(F.lit(0xFFF))) for n in range(4)])


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): links that span the components of one tile pair (b None: a tile with itself)."""
    other = a if b is None else b
    near = np.bitwise_count(a[:, None] ^ other[None, :]) <= radius
    rows, cols = np.arange(len(a)), np.arange(len(other)) if b is None else np.arange(len(other)) + len(a)
    if b is None:
        if near.sum() == len(a):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    elif not near.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    label = np.arange(len(a) if b is None else len(a) + len(b))
    top = len(label)
    while True:
        left = np.minimum(label[rows], np.where(near, label[cols][None, :], top).min(axis=1))
        after = label.copy()
        after[rows] = left
        right = np.minimum(after[cols], np.where(near, left[:, None], top).min(axis=0))
        after[cols] = np.minimum(after[cols], right)
        if (after == label).all():
            break
        label = after
    both = a if b is None else np.concatenate([a, b])
    moved = np.flatnonzero(label != np.arange(top))
    return both[moved], both[label[moved]]


def _sorted(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ones = np.bitwise_count(fps).astype(np.int64)
    order = np.argsort(ones, kind="stable")
    return fps[order], ones[order]


def _tiles(first: np.ndarray, last: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links within one group (last None), or between the two parts of a salted pair."""
    a, p = _sorted(first)
    b, q = (a, p) if last is None else _sorted(last)
    for i in range(0, len(a), TILE):
        for j in range(i if last is None else 0, len(b), TILE):
            if q[j] - p[min(i + TILE, len(a)) - 1] > radius or p[i] - q[min(j + TILE, len(b)) - 1] > radius:
                continue
            yield _forest(a[i : i + TILE], None if last is None and i == j else b[j : j + TILE], radius)


def compare_groups(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links (u, v) within the groups of rows sorted by (key, a, b): fp, side (1: the second part of a salted pair)."""
    held: list[np.ndarray] = []

    def close(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """rows: key, a, b, fp, side of whole groups."""
        if len(rows) < 2:
            return
        cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(rows)]
        keep = np.flatnonzero(ends - starts > 1)
        fps, side = rows[:, 3].copy().view(np.uint64), rows[:, 4]
        out, shared, many = [], [], 0
        for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
            if side[s] != side[e - 1] or rows[s, 1] != rows[s, 2]:  # rows of a group are sorted by side
                out += _tiles(fps[s:e][side[s:e] == 0], fps[s:e][side[s:e] == 1], radius)
            elif e - s > TILE // 2:
                out += _tiles(fps[s:e], None, radius)
            else:
                if many + e - s > TILE:
                    out.append(_forest(np.concatenate(shared), None, radius))
                    shared, many = [], 0
                shared.append(fps[s:e])
                many += e - s
        if shared:
            out.append(_forest(np.concatenate(shared), None, radius))
        if out and len(u := np.concatenate([x for x, _ in out])):
            v = np.concatenate([x for _, x in out])
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], axis=1)
        rows = np.concatenate([*held, rows])
        last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        yield from close(rows[:cut])
        held = [rows[cut:]]
    if held:
        yield from close(held[0])


def links(fps: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """(u, v): links that span the components of the distinct fingerprints ``fps`` (fp long), a written table."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("four blocks are exact up to a radius of 3")
    scratch = Scratch(fps.sparkSession, "links")

    def crowded(dealt: DataFrame, name: str) -> DataFrame:
        return scratch.table(dealt.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > split), name)

    dealt = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    hot = crowded(dealt, "crowded")
    alone = F.lit(0)
    if hot.isEmpty():
        groups = dealt.select("key", alone.alias("a"), alone.alias("b"), "fp", alone.alias("side"))
    else:
        hot = F.broadcast(hot.select("key"))
        fine = dealt.join(hot, "key").select("fp", F.explode(_finer(F.col("fp"), F.col("key"))).alias("key"))
        parts = F.coalesce(F.col("parts"), F.lit(1))
        own = F.pmod(F.xxhash64("fp"), parts).cast("int")
        paired = (
            fine.join(F.broadcast(crowded(fine, "crowded-finer").select("key", F.ceil(F.col("n") / split).cast("int").alias("parts"))), "key", "left")
            .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
            .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", (F.col("own") > F.col("other")).cast("int").alias("side"))
        )
        groups = dealt.join(hot, "key", "left_anti").select("key", alone.alias("a"), alone.alias("b"), "fp", alone.alias("side")).union(paired)
    return groups.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side").mapInArrow(lambda b: compare_groups(b, radius), "u long, v long")


def _components(docs: DataFrame, radius: int, similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, least, root) of each fingerprint: its smallest id and its component's name."""
    scratch = Scratch(docs.sparkSession, "simhash")
    each = scratch.table(fingerprints(docs) if similarity is None else nearcopies.sketches(docs, fingerprint), "fingerprints")
    distinct = scratch.table(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    of = connected_components(links(distinct.select("fp"), radius), scratch)
    root = distinct.join(of, distinct.fp == of.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = scratch.table(root, "roots")
    return each, roots if similarity is None else nearcopies.join_alike(each, roots, similarity, scratch)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs`` (doc_id, text)."""
    each, root = _components(docs, radius)
    component = root.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = root.join(component, "root").select("fp", "component_id")
    return each.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: the one with the smallest id.

    With a similarity, texts whose five-word shingles are that much alike are linked too, whatever their fingerprints.
    """
    each, root = _components(docs, radius, similarity)
    least = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("m")  # null ids come last
    name, near, own = unused(docs, "_id", "_fp", "_own")
    kept = root.groupBy("root").agg(least).select(F.col("m.least").alias(name), F.col("m.fp").alias(near))
    if each.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return docs.join(kept, F.col("doc_id") == F.col(name), "left_semi")
    # Ids that are shared or null don't name a row: here the fingerprint is part of the name, and equal rows fall together.
    place, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            fp = np.fromiter((fingerprint((t or "").encode()) for t in batch.column(place).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names=[*batch.schema.names, own])

    named = docs.mapInArrow(run, T.StructType([*schema.fields, T.StructField(own, T.LongType())]))
    chosen = named.join(kept, F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(own) == F.col(near)), "left_semi")
    return chosen.dropDuplicates(["doc_id", own]).drop(own)
