"""Keyword search: postings with positions, phrases, and BM25.

A query's white-space separated parts are phrases; a document must hold all of
them. A phrase is a run of tokens at adjacent positions. Phrases without tokens
count for nothing; a query of only such phrases finds nothing. Scores are
negative, lower is better.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreseek.functions.porter import stem as porter_stem
from loreseek.functions.text import ascii_tokens, query_phrases
from loreseek.sources.shared import bound_batches

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
PIECE = 1 << 16  # words
_TOKEN = re.compile(r"[a-z0-9\x80-\U0010ffff]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def tokens_of(text: str, stem: bool = True) -> list[str]:
    """The tokens of a short text, on the driver."""
    found = _TOKEN.findall(text.translate(_LOWER))
    return [porter_stem(t) for t in found] if stem else found


def stems(lists: pa.ListArray) -> pa.ListArray:
    """Lists of the stems of lists of words. Python holds the different words of a piece only."""
    words, done = lists.flatten(), []
    for at in range(0, len(words), PIECE):
        piece = words.slice(at, PIECE).dictionary_encode()
        done.append(pa.array([porter_stem(w) for w in piece.dictionary.to_pylist()], pa.string()).take(piece.indices))
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays([*done, pa.array([], pa.string())]))


def tokens(text: Column, stem: bool = True) -> Column:
    """Tokens of a column; without stems this stays in the JVM."""
    if not stem:
        return ascii_tokens(text)

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        return stems(lists)

    return run(F.coalesce(ascii_tokens(text), F.array().cast("array<string>")))


def build(docs: DataFrame, stem: bool = True) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of ``docs`` (blob_hash, content).

    Postings are ranged by term and document before they are grouped: one shuffle gives groups, files
    sorted by term (so scans skip row groups), and several tasks to a term that most documents hold.
    """
    bound_batches(docs.sparkSession)
    listed = docs.select("blob_hash", tokens(F.col("content"), stem).alias("tokens"))
    lengths = listed.select("blob_hash", F.greatest(F.size("tokens"), F.lit(0)).alias("dl"))
    each = listed.select("blob_hash", F.posexplode("tokens").alias("pos", "term"))
    grouped = each.repartitionByRange("term", "blob_hash").groupBy("term", "blob_hash")
    postings = grouped.agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return postings, lengths


def build_for(docs: DataFrame, terms: list[str], stem: bool = True) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) as ``build`` gives them, postings of a few terms only: for texts that have no index.

    ``docs`` (blob_hash, content) may hold a blob several times. A text is read once and reduced to its length and
    the places of the terms before anything moves; both results share that one exchange.
    """
    bound_batches(docs.sparkSession)
    listed = docs.select("blob_hash", tokens(F.col("content"), stem).alias("tokens"))
    places = F.filter(F.transform("tokens", lambda t, k: F.struct(t.alias("t"), k.alias("k"))), lambda x: x["t"].isin(terms))
    reduced = listed.select("blob_hash", F.struct(F.greatest(F.size("tokens"), F.lit(0)).alias("dl"), places.alias("places")).alias("r"))
    once = reduced.groupBy("blob_hash").agg(F.first("r").alias("r"))
    lengths = once.select("blob_hash", "r.dl")
    of = lambda t: F.struct(t.alias("term"), F.transform(F.filter("r.places", lambda x: x["t"] == t), lambda x: x["k"]).alias("positions"))
    each = once.select("blob_hash", F.explode(F.transform(F.lit(sorted(set(terms))).cast("array<string>"), of)).alias("p")).filter(F.size("p.positions") > 0)
    return each.select("p.term", "blob_hash", F.size("p.positions").alias("tf"), "p.positions"), lengths


def phrase_terms(queries: DataFrame, stem: bool = True) -> DataFrame:
    """(query_id, phrase_no, i, term, many, wanted) of ``queries`` (query_id, text): the terms of each phrase, their number, and that of the query's phrases."""
    phrases = queries.select("query_id", F.posexplode(query_phrases(F.col("text"))).alias("phrase_no", "phrase"))
    split = phrases.select("query_id", "phrase_no", tokens(F.col("phrase"), stem).alias("tokens"))
    each = split.select("query_id", "phrase_no", F.size("tokens").alias("many"), F.posexplode("tokens").alias("i", "term"))
    return each.withColumn("wanted", F.size(F.collect_set("phrase_no").over(Window.partitionBy("query_id"))))


def phrase_counts(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, phrase_no, wanted, blob_hash, tf): how often a document holds a phrase."""
    hits = postings.join(terms, "term")
    # The places at which a phrase would begin, for each of its terms; it is there where all agree.
    starts = F.transform("positions", lambda p: p - F.col("i"))
    found = hits.groupBy("query_id", "phrase_no", "wanted", "blob_hash", "many").agg(F.collect_list(starts).alias("starts")).filter(F.size("starts") == F.col("many"))
    common = F.aggregate(F.slice("starts", 2, F.greatest(F.col("many"), F.lit(1))), F.col("starts")[0], lambda a, b: F.array_intersect(a, b))
    return found.select("query_id", "phrase_no", "wanted", "blob_hash", F.size(common).cast("long").alias("tf")).filter("tf > 0")


def match(counts: DataFrame) -> DataFrame:
    """(query_id, blob_hash) of documents with all phrases of a query."""
    return counts.groupBy("query_id", "wanted", "blob_hash").agg(F.count("*").alias("n")).filter("n = wanted").select("query_id", "blob_hash")


def bm25(postings: DataFrame, lengths: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, blob_hash, bm25) of the matching documents.

    No join has a query as its key, which all matching documents would share, but for that with the phrases'
    document counts: those are a row a phrase, as many as the caller's block of queries holds, and are broadcast.
    """
    counts = phrase_counts(postings, terms)
    totals = lengths.agg(F.struct(F.count("*").alias("docs"), F.avg("dl").alias("mean")).alias("totals"))
    spread = F.broadcast(counts.groupBy("query_id", "phrase_no").agg(F.count("*").alias("n")))
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weight = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    # One row of totals; as a scalar subquery it joins nothing.
    scored = counts.join(spread, ["query_id", "phrase_no"]).join(lengths, "blob_hash").withColumn("totals", totals.scalar()).select("*", "totals.docs", "totals.mean")
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    summed = scored.groupBy("query_id", "wanted", "blob_hash").agg((-F.sum(part)).alias("bm25"), F.count("*").alias("n"))
    return summed.filter("n = wanted").select("query_id", "blob_hash", "bm25")


def best(scored: DataFrame, limit: int, score: str = "bm25", descending: bool = False) -> DataFrame:
    """The ``limit`` best rows of each query, ties by hash: partial and final limits by group, no full sort."""
    order = F.col(score).desc() if descending else F.col(score)
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "blob_hash"))).filter(F.col("_n") <= limit).drop("_n")
