"""Links between texts whose sets of five-word shingles are alike, added to SimHash components.

Each text has ``BANDS`` keys of ``ROWS`` minimal shingle hashes each. Texts with
a similarity of 0.8 share none of the 32 keys of five with a chance of 3 in a
million, and texts that share a passage only rarely share one. Pairs that share
a key and are not yet in one component are compared on their whole sets of
shingles (32-bit hashes), so no link rests on an estimate.

Under each key a text is drawn as its pivot, the same for keys that hold the same
texts where possible, and each text is compared with one pivot of another
component: a row a text and round, whatever the size of a group. After ``STARS``
rounds groups of copies are one component but for a few texts. What is still
apart under a key is then compared whole, every pair of different components:
a key's texts are dealt to parts of ``PART``, and those outside the key's largest
component go to all of its parts. A part emits a link for each pair of
components, never pairs of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreseek.llm.common import connected_components, pieces
from loreseek.sources.shared import Scratch

WORDS = 5
BANDS, ROWS = 32, 5
STARS = 3
PART = 1024
_FACTORS = np.random.default_rng(42).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> tuple[int, np.ndarray]:
    """A hash of the text's words, and the distinct hashes of its shingles."""
    found = text.lower().split()
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(joined, 42), np.array([digest(joined, 42)] if found else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-words] + 1].tolist()
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    return digest(joined, 42), np.unique(hashes)


def keys(hashes: np.ndarray) -> np.ndarray:
    """The key of each band: a hash of the band's number and its minimal hashes."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[None, at : at + 1024] * _FACTORS[:, None]).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def sketches(docs: DataFrame, fingerprint) -> DataFrame:
    """(doc_id, fp, digest, n, keys, shingles, rid): ``rid`` is the row's own number, once the frame is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            fps = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
            each = [shingles(t) for t in texts]
            sets = [np.unique(h.astype(np.uint32)).view(np.int32) for _, h in each]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(fps.view(np.int64)),
                    pa.array(np.array([d for d, _ in each], np.uint64).view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([keys(h) for _, h in each], pa.list_(pa.int64())),
                    pa.array(sets, pa.list_(pa.int32())),
                ],
                names=["doc_id", "fp", "digest", "n", "keys", "shingles"],
            )

    made = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, digest long, n int, keys array<long>, shingles array<int>")
    return made.withColumn("rid", F.monotonically_increasing_id())


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the roots x and y of the pairs (a, b, x, y) whose sets of shingles are alike; b names a pair, a may be that of many."""
    own = pairs.join(sets.select(F.col("rid").alias("b"), F.col("shingles").alias("t")), "b")
    both = own.join(sets.select(F.col("rid").alias("a"), F.col("shingles").alias("s")), "a").filter(F.least(F.size("s"), F.size("t")) >= similarity * F.greatest(F.size("s"), F.size("t")) - 1e-9)
    common = both.select("x", "y", (F.size("s") + F.size("t")).alias("n"), F.size(F.array_intersect("s", "t")).alias("c"))
    return common.filter(F.col("c") >= similarity * (F.col("n") - F.col("c")) - 1e-9).select(F.col("x").alias("u"), F.col("y").alias("v"))


def _compared(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(u, v): components with alike texts, from rows (key, part, pivot, root, shingles) sorted by key and part.

    Within a part each pivot meets all other texts at once: places of the pivot's hashes in the texts laid end to end are counted.
    """

    def close(rows: list[tuple]) -> list[tuple[int, int]]:
        members = [(root, s) for pivot, root, s in rows if not pivot]
        if not members:
            return []
        roots = np.array([root for root, _ in members])
        sizes = np.array([len(s) for _, s in members])
        flat, starts = np.concatenate([s for _, s in members]), np.r_[0, np.cumsum(sizes)[:-1]]
        found: set[tuple[int, int]] = set()
        for root, s in ((root, s) for pivot, root, s in rows if pivot):
            near = (roots != root) & (np.minimum(sizes, len(s)) >= similarity * np.maximum(sizes, len(s)) - 1e-9)
            if near.any():
                common = np.add.reduceat(np.isin(flat, s), starts)
                alike = near & (common >= similarity * (sizes + len(s) - common) - 1e-9)
                found |= {(int(root), int(r)) for r in np.unique(roots[alike])}
        return sorted(found)

    def made(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

    held, at = [], None
    for batch in batches:
        key, part, pivot, root = (batch.column(k).to_pylist() for k in range(4))
        sets = batch.column(4)
        for k in range(batch.num_rows):
            if (key[k], part[k]) != at:
                if held and (links := close(held)):
                    yield made(links)
                held, at = [], (key[k], part[k])
            held.append((pivot[k], root[k], sets[k].values.to_numpy()))
    if held and (links := close(held)):
        yield made(links)


def _joined(roots: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    of = connected_components(links, Scratch(scratch.spark, name))
    after = roots.join(of.withColumnRenamed("root", "next"), roots.root == F.col("node"), "left")
    return scratch.table(after.select("fp", "least", F.coalesce("next", "root").alias("root")), name)


def join_alike(each: DataFrame, roots: DataFrame, similarity: float, scratch: Scratch, stars: int = STARS, part: int = PART) -> DataFrame:
    """``roots`` (fp, least, root) with the components joined that hold alike texts of ``each`` (written ``sketches``)."""
    one = scratch.table(each.groupBy("digest").agg(F.min("rid").alias("rid")).select("rid"), "one")
    sets = each.select("rid", "shingles")

    def apart(now: DataFrame, k: int) -> DataFrame:
        """The rows (key, rid, fp, root) of keys that hold texts of several components."""
        several = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
        return scratch.table(now.join(several, "key", "left_semi"), f"apart-{k}")

    named = lambda rows: rows.join(roots.select("fp", "root"), "fp")
    bands = named(each.select("rid", "fp", "keys").join(one, "rid", "left_semi")).select("rid", "fp", "root", F.explode("keys").alias("key"))
    rows = apart(scratch.table(bands, "bands"), 0)
    scratch.drop("bands")
    sets = scratch.table(sets.join(rows.select("rid").distinct(), "rid", "left_semi"), "sets")  # of the few texts still to compare
    for k in range(stars):
        drawn = F.min(F.struct(F.xxhash64("rid", F.lit(k)).alias("order"), "rid", "root")).alias("pivot")
        pairs = rows.join(rows.groupBy("key").agg(drawn), "key").filter("root <> pivot.root").groupBy("rid").agg(F.min("pivot").alias("pivot"), F.first("root").alias("root"))
        pairs = pairs.select(F.col("pivot.rid").alias("a"), F.col("rid").alias("b"), F.col("pivot.root").alias("x"), F.col("root").alias("y"))
        roots = _joined(roots, _alike(scratch.table(pairs, f"pairs-{k}"), sets, similarity), scratch, f"starred-{k}")
        rows = apart(named(rows.select("key", "rid", "fp")), k + 1)  # components only grow, so no other key comes back
        scratch.drop(f"apart-{k}")
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.ceil(F.sum("n") / part).cast("int").alias("parts"))
    rows = rows.select("key", "rid", "root").join(scratch.table(sizes, "sizes"), "key")
    own = F.array(F.struct(F.pmod(F.xxhash64("rid", "key"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("pivot")))
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(True).alias("pivot")))
    dealt = rows.select("key", "rid", "root", F.explode(F.when(F.col("root") == F.col("main"), own).otherwise(F.concat(own, every))).alias("d"))
    dealt = dealt.join(sets, "rid").select("key", "d.part", "d.pivot", "root", "shingles")
    links = dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(lambda b: _compared(b, similarity), "u long, v long")
    roots = _joined(roots, links, scratch, "joined")
    scratch.drop(f"apart-{stars}")
    scratch.drop("sets")
    return roots
