"""Exact top-k inner products by norm-bucketed retrieval.

Components are floor(1024 * x) of the doubles; scores are integers. Candidates
are cut by length into buckets: an aggregate over a fixed number of length
classes gives the place of each class, and vectors are dealt to buckets by
range of length. A seed bucket of fixed size, the longest vectors, gives each
query a first threshold: the k-th best score so far can only rise.

A bucket with greatest length L needs, for a query of length l and threshold t,
a cosine of t / (l * L) at least. Above 1 the bucket is skipped. Otherwise its
vectors are pruned by length (those that are too short even in the query's
direction), or, where the local cosine threshold is high, by coordinate: on the
query's largest coordinates a vector at that cosine lies within bounds. What
remains is verified by whole products.

Queries go in blocks of ``QUERIES``, and buckets are dealt to groups of about
``GROUP``. Each block is sent to each group and meets the group's buckets by an
equal join on the group's number: so vectors move once, a task holds one group,
and only k rows a query leave a bucket.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows with a null id or no components; a query meets the
candidates of its own dimension; rows that share the query's id are not its
candidates; repeated rows are candidates each, ties going to the smaller id;
scores beyond 64 bits stop at their bound; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreseek.sources.shared import Scratch

K = 10
EVERY = 100
SCALE = 1024
BUCKET = 4096  # vectors of a bucket, about
QUERIES = 1024  # queries of a block
NUMBERS = 1 << 20  # components of a bucket or a block, at most
GROUP = 32  # buckets of a group
FOCUS = 3  # coordinates that are tested
STEEP = 0.8  # local cosine threshold from which coordinates prune
_EXACT = float(1 << 52)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dims, length) of the vectors that take part; v holds whole doubles."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x).alias("x")).filter("vec_id is not null and size(x) > 0")
    finite = whole.filter(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # floor() of a double gives a long; rint of the rest keeps doubles beyond 2**63 as they are.
    scaled = lambda x: F.when(F.abs(x * SCALE) < float(1 << 53), F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)
    v = finite.select("vec_id", F.transform("x", scaled).alias("v"))
    return v.select("vec_id", "v", F.size("v").alias("dims"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("length"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole-number products of two matrices of whole doubles, exact; int64, stopped at its bounds."""
    if len(q) and len(c) and np.abs(q).max() * np.abs(c).max() * q.shape[1] < _EXACT:
        return (q @ c.T).astype(np.int64)
    wide = np.vectorize(int, otypes=[object])
    out = wide(q) @ wide(c).T if len(q) and len(c) else np.zeros((len(q), len(c)), object)
    return np.clip(out, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher score, then smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some].astype(object) if scores.min() == -(1 << 63) else -scores[some]))[:k]]
    return np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == -(1 << 63) else -scores))[:k]


def search_bucket(query_ids, q, q_length, threshold, ids, c, c_length, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, candidate ids, scores) of a bucket's vectors that can be among a query's k best.

    threshold: a score that k other candidates of the query are known to reach (-inf: none).
    """
    order = np.argsort(-c_length, kind="stable")
    ids, c, c_length = ids[order], c[order], c_length[order]
    slack = 1 + 1e-9
    reach = q_length * (c_length[0] if len(c) else 0.0) * slack
    for at in range(0, len(q), 64):
        part = np.arange(at, min(at + 64, len(q)))
        part = part[reach[part] >= threshold[part]]
        if not len(part):
            continue
        need = np.where(q_length[part] > 0, threshold[part] / np.maximum(q_length[part], 1e-300), -np.inf)
        enough = np.searchsorted(-c_length * slack, -need, side="right")  # by length: this many of the longest
        steep = need / max(c_length[0], 1e-300) >= STEEP
        flat = part[~steep]
        if len(flat):
            top = int(enough[~steep].max())
            scores = products(q[flat], c[:top])
            for row, qi in enumerate(flat.tolist()):
                yield from _kept(query_ids[qi], scores[row], ids[:top], threshold[qi], k)
        for qi, top, local in zip(part[steep].tolist(), enough[steep].tolist(), need[steep].tolist(), strict=True):
            some = _by_coordinates(q[qi] / q_length[qi], c[:top], c_length[:top], local)
            yield from _kept(query_ids[qi], products(q[qi : qi + 1], c[some])[0], ids[some], threshold[qi], k)


def _by_coordinates(unit: np.ndarray, c: np.ndarray, c_length: np.ndarray, need: float) -> np.ndarray:
    """Places of vectors that can have a product of ``need`` with the unit vector, judged by its largest coordinates.

    A vector of length l at cosine t or more has, on a coordinate where the unit vector has u, between
    l * (t * u - s) and l * (t * u + s) with s = sqrt((1 - t * t) * (1 - u * u)), or more if u is above t.
    """
    some = np.arange(len(c))
    for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
        u, lengths = abs(float(unit[f])), np.maximum(c_length[some], 1e-300)
        t = np.minimum(need / lengths, 1.0)
        spread = np.sqrt(np.maximum(0.0, (1 - t * t) * (1 - u * u)))
        x = c[some, f] * np.sign(unit[f]) / lengths
        high = np.where(u >= t, 1.0, t * u + spread)
        some = some[(x >= t * u - spread - 1e-9) & (x <= high + 1e-9)]
    return some


def _kept(query_id: int, scores: np.ndarray, ids: np.ndarray, threshold: float, k: int):
    fit = np.flatnonzero((scores >= threshold) & (ids != query_id))
    if len(fit):
        fit = fit[best(scores[fit], ids[fit], k)]
        yield np.full(len(fit), query_id, np.int64), ids[fit], scores[fit]


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, bucket: int = BUCKET, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each row whose id ``every`` divides, among ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    room = lambda most: F.least(F.lit(most), F.greatest(F.lit(16), F.floor(F.lit(NUMBERS) / F.col("dims"))))
    all_vectors = scratch.table(usable(vectors), "vectors")
    # Buckets of about equal size: classes of length to three digits, cut where the running count passes a multiple.
    digits = F.when(F.col("length") > 0, F.floor(F.log10("length") * 1000)).otherwise(F.lit(-400_000)).cast("int")
    classes = all_vectors.groupBy("dims", digits.alias("class")).agg(F.count("*").alias("n"))
    longest = Window.partitionBy("dims").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("before", F.coalesce(F.sum("n").over(longest), F.lit(0)))
    # A class beyond a bucket's size is salted into several buckets.
    classes = scratch.table(classes.select(F.col("dims").alias("d"), F.col("class").alias("l"), F.floor(F.col("before") / room(bucket)).cast("int").alias("bucket"), F.ceil(F.col("n") / room(bucket)).cast("int").alias("parts")), "classes")
    placed = all_vectors.withColumn("class", digits).join(classes, (F.col("dims") == F.col("d")) & (F.col("class") == F.col("l")))
    placed = placed.select("dims", "bucket", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v", "length")
    packed = placed.groupBy("dims", "bucket", "part").agg(F.collect_list(F.struct("vec_id", "length", "v")).alias("rows"))
    buckets = scratch.table(packed.select("dims", "bucket", "part", F.col("rows.vec_id").alias("ids"), F.col("rows.length").alias("lengths"), F.flatten("rows.v").alias("flat")), "buckets")

    asked = all_vectors.filter(F.col("vec_id") % every == 0)
    blocks = asked.groupBy("dims").agg(F.count("*").alias("n")).select(F.col("dims").alias("d"), F.ceil(F.col("n") / room(block)).cast("int").alias("blocks"))
    asked = asked.join(blocks, F.col("dims") == F.col("d")).select("dims", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v", "length")
    questions = asked.groupBy("dims", "block").agg(F.collect_list(F.struct("vec_id", "length", "v")).alias("rows"))
    questions = scratch.table(questions.select(F.col("dims").alias("d"), F.col("block").alias("b"), F.col("rows.vec_id").alias("q_ids"), F.col("rows.length").alias("q_lengths"), F.flatten("rows.v").alias("q_flat")), "questions")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                dims, ids, lengths, flat, q_ids, q_lengths, q_flat, known = (batch.column(j)[n] for j in range(8))
                array = lambda x: np.asarray(x.values)
                q = array(q_flat).reshape(-1, dims.as_py())
                low = dict(known.as_py()) if known.is_valid else {}
                threshold = np.array([low.get(i, -np.inf) for i in array(q_ids).tolist()], float)
                found = list(search_bucket(array(q_ids), q, array(q_lengths), threshold, array(ids), array(flat).reshape(-1, dims.as_py()), array(lengths), k))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    shape = "query_id long, vec_id long, score long"
    columns = ["dims", "ids", "lengths", "flat", "q_ids", "q_lengths", "q_flat", "known"]
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    # The seed bucket of each dimension stands once beside each block.
    first = buckets.filter("bucket = 0 and part = 0").join(blocks, F.col("dims") == F.col("d")).select("dims", "ids", "lengths", "flat", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    first = first.join(questions, (F.col("dims") == F.col("d")) & (F.col("block") == F.col("b"))).withColumn("known", F.lit(None).cast("map<long,double>"))
    seed = scratch.table(ranked(first.select(*columns).mapInArrow(search, shape)), "seed")
    known = seed.filter(F.col("rank") == k).join(asked.select("dims", "block", F.col("vec_id").alias("query_id")), "query_id")
    # Neighbouring doubles are 1 apart only up to 2**53; beyond, the threshold is lowered to stay below the score.
    low = F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15
    known = known.groupBy(F.col("dims").alias("kd"), F.col("block").alias("kb")).agg(F.map_from_entries(F.collect_list(F.struct("query_id", low.alias("t")))).alias("known"))
    number = buckets.count()
    groups = max(1, -(-number // GROUP), min(number, 2 * spark.sparkContext.defaultParallelism))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = buckets.filter("not (bucket = 0 and part = 0)").withColumn("g", F.pmod(F.xxhash64("bucket", "part"), F.lit(groups)).cast("int")).repartition(tasks, "dims", "g")
    sent = questions.join(known, (F.col("d") == F.col("kd")) & (F.col("b") == F.col("kb")), "left").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(tasks, "d", "group")
    # The group's buckets, of bounded size, are the side that a sort-merge join holds.
    met = sent.join(rest, (F.col("d") == F.col("dims")) & (F.col("group") == F.col("g"))).select(*columns)
    found = seed.select("query_id", "vec_id", "score").union(met.mapInArrow(search, shape))
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same in DuckDB SQL: queries against all rows.
TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
