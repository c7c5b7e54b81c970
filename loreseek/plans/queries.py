"""The registered queries: the engine's operators over the driver's tables, each over whole tables.

Documents stand in for file contents (content hash, path, branch), orders and
lineitem for commits and their links, embeddings for vectors, events for
settings that are written again and again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreseek.functions import scores, text
from loreseek.functions.chunking import FixedChunker, chunks
from loreseek.functions.embedding import DeterministicProvider
from loreseek.functions.hashing import git_blob_hash, utf16_length
from loreseek.functions.vectors import dequantize, quantize
from loreseek.operators import evaluation, fts, relational, vector_search, walk
from loreseek.operators.fallback import embed_with_fallback
from loreseek.plans import search
from loreseek.session import spread
from loreseek.sources.shared import Scratch, bound_batches

WORDS, PHRASE = "the and that", "of-the and"
MODEL_K, CAP = 10, 20_000


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _path() -> Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, blob_hash, path, branch, content: an entry for each document."""
    return _read(spark, d, "documents").select("doc_id", F.sha1("text").alias("blob_hash"), _path().alias("path"), F.col("source").alias("branch"), F.col("text").alias("content"))


def _epoch(column: str) -> Column:
    """Epoch seconds of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"cast(cast({column} - timestamp_ntz'1970-01-01 00:00:00' as interval second) as bigint)")


def _commits(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("commit_hash"), _epoch("o_orderdate").alias("timestamp"))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return _blobs(spark, d).select("blob_hash", "content").dropDuplicates(["blob_hash"])


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """blob_hash, content: for work that takes long on each text."""
    return spread(_read(spark, d, "documents").select("text")).select(F.sha1("text").alias("blob_hash"), F.col("text").alias("content"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, q: quantised embeddings."""
    return _read(spark, d, "embeddings").select("vec_id", "label", quantize(F.col("embedding")).alias("q"))


def _asked(spark: SparkSession, d: str) -> list[float]:
    """The first vector, as the query: a point lookup, as an embedding endpoint would answer it on the driver."""
    row = _read(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()
    return list(row[0]) if row and row[0] else []


def _scored(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


# -- registry


def blob_registry(spark, d):
    size = utf16_length(F.col("content")).cast("long")
    each = _blobs(spark, d).select("blob_hash", size.alias("size"), text.end_line(F.col("content")).cast("long").alias("end_line"))
    return each.groupBy("blob_hash").agg(F.max("size").alias("size"), F.max("end_line").alias("end_line"), F.count("*").alias("entries"))


def paths_for_blob(spark, d):
    return relational.paths_for(_blobs(spark, d)).select("blob_hash", F.array_join("paths", "|").alias("paths"))


def branches_for(spark, d):
    return relational.branches_for(_blobs(spark, d)).select("blob_hash", F.array_join("branches", "|").alias("branches"))


def blobs_on_branch(spark, d):
    return relational.on_branch(_blobs(spark, d), "src1")


def _indexed(spark, d):
    return _blobs(spark, d).join(_read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("blob_hash")


def blob_exists_semi(spark, d):
    return relational.exists_in(_blobs(spark, d).select("doc_id", "blob_hash"), _indexed(spark, d), "blob_hash")


def filter_new_blobs_anti(spark, d):
    return relational.filter_new(_blobs(spark, d).select("blob_hash"), _indexed(spark, d), "blob_hash")


def insert_or_ignore(spark, d):
    present = _indexed(spark, d).distinct().withColumn("origin", F.lit("present"))
    rows = _blobs(spark, d).select("blob_hash").withColumn("origin", F.lit("new"))
    return relational.insert_or_ignore(present, rows, ["blob_hash"])


def first_seen(spark, d):
    links = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("blob_hash"), F.col("l_orderkey").alias("commit_hash"))
    seen = relational.first_seen(links, _commits(spark, d))
    return _read(spark, d, "part").select(F.col("p_partkey").alias("blob_hash"), F.col("p_name").alias("path")).join(seen, "blob_hash", "left")


def blob_commit_links(spark, d):
    return _read(spark, d, "lineitem").select(F.col("l_partkey").alias("blob"), F.col("l_orderkey").alias("commit")).distinct()


def embed_config_latest(spark, d):
    events = _read(spark, d, "events").select("user_id", "event_type", F.round("value", 6).alias("value"), "ts", "event_id")
    newest = relational.latest(events, ["user_id"], F.struct("ts", "event_id"))
    return newest.select("user_id", "event_type", "value", _epoch("ts").alias("updated_at"))


def most_recent_ref(spark, d):
    return _read(spark, d, "events").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("ref"))


def counts(spark, d):
    blobs = _blobs(spark, d).agg(F.countDistinct("blob_hash").alias("blobs"), F.count("*").alias("entries"))
    return blobs.withColumn("commits", _read(spark, d, "orders").agg(F.count("*")).scalar())


def vector_entry_for(spark, d):
    """One vector by its key."""
    row = relational.entry_for(_read(spark, d, "embeddings").select("vec_id", "label", "embedding"), vec_id=7)
    q = row.select("vec_id", "label", quantize(F.col("embedding")).alias("q"))
    return q.select("vec_id", "label", F.array_join(F.col("q.q_data").cast("array<string>"), ",").alias("q_data"))


def content_for(spark, d):
    """One text by its hash, which is that of document 0 and may be held by several."""
    wanted = _read(spark, d, "documents").filter("doc_id = 0").select(F.sha1("text")).scalar()
    return _blobs(spark, d).filter(F.col("blob_hash") == wanted).select("blob_hash", "content").distinct()


def last_commit_by_insert(spark, d):
    """The commit that was inserted last: the order of the latest date, ties by key."""
    return relational.last_by_insert(_commits(spark, d), "commit_hash", "timestamp", "commit_hash")


def count_for_model(spark, d):
    return relational.count_for_model(_read(spark, d, "embeddings").select(F.col("label").alias("model"), F.floor(F.col("vec_id") / 4).alias("blob_hash")))


def oversized_tally(spark, d):
    size = F.octet_length("content")
    return _blobs(spark, d).agg(F.count_if(size > CAP).alias("oversized"), F.count_if(size <= CAP).alias("fitting"))


def index_tally(spark, d):
    entries = _blobs(spark, d)
    fresh = filter_new_blobs_anti(spark, d).join(_contents(spark, d), "blob_hash")
    new = fresh.agg(F.count("*").alias("new"), F.count_if(F.octet_length("content") > CAP).alias("oversized"))
    seen = entries.agg(F.count("*").alias("seen"))
    return seen.select("seen", (F.col("seen") - new.select("new").scalar()).alias("skipped"), (new.select("new").scalar() - new.select("oversized").scalar()).alias("indexed"), new.select("oversized").scalar().alias("oversized"))


def git_blob_ids(spark, d):
    return _blobs(spark, d).select("doc_id", git_blob_hash(F.col("content")).alias("object_id"))


def latest_path_in_window(spark, d):
    """Windows of 500 entries by branch; a content that comes again in a window keeps its last path."""
    windows = walk.count_windows(_blobs(spark, d), F.col("doc_id"), 500, ["branch"])
    return windows.groupBy("branch", "window_no", "blob_hash").agg(F.max_by("path", "doc_id").alias("path"), F.count("*").alias("entries"))


# -- chunks


def file_chunk_spans(spark, d):
    return _blobs(spark, d).select("doc_id", F.lit(1).alias("start_line"), text.end_line(F.col("content")).cast("int").alias("end_line"))


def _fixed(spark, d, window):
    bound_batches(spark)
    cut = chunks(F.col("content"), FixedChunker(window))
    each = _blobs(spark, d).select("doc_id", F.posexplode(cut).alias("chunk_index", "c"))
    return each.select("doc_id", "chunk_index", "c.start_line", "c.end_line", F.length("c.content").alias("n_chars"))


def fixed_chunks_1500(spark, d):
    return _fixed(spark, d, 1500)


def fixed_chunks_800(spark, d):
    return _fixed(spark, d, 800)


def fallback_chain(spark, d):
    """How each content gets its vectors, with a model that takes 1,600 characters."""
    vectors, failed = embed_with_fallback(_contents(spark, d), DeterministicProvider(max_length=1600), Scratch(spark, "fallback").table, concurrency=spark.sparkContext.defaultParallelism)
    done = vectors.groupBy("blob_hash").agg(F.when(F.min("chunk_index") < 0, F.lit(0)).otherwise(F.count("*")).cast("long").alias("chunks"), F.lit(True).alias("embedded"))
    return done.union(failed.select("blob_hash", F.lit(0).cast("long").alias("chunks"), F.lit(False).alias("embedded")))


# -- vectors


def quantized(spark, d):
    v = _vectors(spark, d)
    return v.select("vec_id", F.round(F.col("q.q_min").cast("double"), 6).alias("q_min"), F.round(F.col("q.q_scale").cast("double"), 9).alias("q_scale"), F.array_join(F.col("q.q_data").cast("array<string>"), ",").alias("q_data"))


def dequantize_error(spark, d):
    v = _read(spark, d, "embeddings").select("vec_id", "embedding", quantize(F.col("embedding")).alias("q"))
    error = F.array_max(F.zip_with(F.col("embedding"), dequantize(F.col("q.q_min"), F.col("q.q_scale"), F.col("q.q_data")), lambda x, y: F.abs(x - y)))
    return v.select("vec_id", F.round(error.cast("double"), 6).alias("max_error"))


def _by_blob(v: DataFrame, blob: Column) -> DataFrame:
    return v.select(F.sha1(blob.cast("string")).alias("blob_hash"), "q.q_min", "q.q_scale", "q.q_data", "label")


def vector_topk(spark, d):
    return _scored(vector_search.search(_by_blob(_vectors(spark, d), F.col("vec_id")), _asked(spark, d), MODEL_K))


def vector_topk_branch(spark, d):
    v = _by_blob(_vectors(spark, d), F.col("vec_id"))
    return _scored(vector_search.search(v, _asked(spark, d), MODEL_K, v.filter("label = 3").select("blob_hash")))


def vector_topk_chunks(spark, d):
    return _scored(vector_search.search(_by_blob(_vectors(spark, d), F.floor(F.col("vec_id") / 4)), _asked(spark, d), MODEL_K))


# -- text


def path_relevance(spark, d):
    return _blobs(spark, d).select("doc_id", F.round(text.path_relevance(F.lit("SRC1 en/missing"), F.col("path")), 6).alias("relevance"))


def quoted_queries(spark, d):
    return _read(spark, d, "benchmark").select("item_id", text.quoted_query(F.col("text")).alias("quoted"))


def context_errors(spark, d):
    return _read(spark, d, "conversations").select("conv_id", "turn", text.is_context_error(F.col("text")).alias("context_error"))


def _keyword(spark, d, query, stem=False):
    postings, lengths = fts.build_for(_texts(spark, d), fts.tokens_of(query, stem), stem)
    terms = fts.phrase_terms(spark.createDataFrame([(0, query)], "query_id long, text string"), stem)
    return postings, lengths, terms


def fts_match(spark, d):
    postings, _, terms = _keyword(spark, d, WORDS)
    return fts.match(fts.phrase_counts(postings, terms)).select("blob_hash")


def fts_bm25_nostem(spark, d):
    return _scored(fts.bm25(*_keyword(spark, d, WORDS)).select("blob_hash", "bm25"))


def fts_phrase(spark, d):
    return _scored(fts.bm25(*_keyword(spark, d, PHRASE)).select("blob_hash", "bm25"))


def fts_porter(spark, d):
    return _scored(fts.bm25(*_keyword(spark, d, "ings of-the", stem=True)).select("blob_hash", "bm25"))


def fts_vocabulary(spark, d):
    postings, _ = fts.build(_texts(spark, d).dropDuplicates(["blob_hash"]), stem=False)
    return postings.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


# -- scores


def minmax_norm(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("value"))
    return _scored(scores.min_max_by(docs, "value", ["source"], "score").select("doc_id", "score"))


def hybrid_blend(spark, d):
    """Both legs of sixteen queries; ids on one side only count 0 on the other."""
    v = _read(spark, d, "embeddings").select(F.pmod("vec_id", F.lit(16)).alias("query_id"), F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("s"))
    b = _read(spark, d, "documents").select(F.pmod("doc_id", F.lit(16)).alias("query_id"), F.col("doc_id").alias("id"), (-F.col("n_chars").cast("double")).alias("bm25"))
    v = scores.min_max_by(v, "s", ["query_id"], "v").drop("s")
    b = scores.min_max_by(b.select("query_id", "id", (-F.col("bm25")).alias("t")), "t", ["query_id"], "b").drop("t")
    return v.join(b, ["query_id", "id"], "full_outer").select("query_id", "id", F.round(scores.blend(F.col("v"), F.col("b")), 6).alias("score"))


def _order_signals(spark, d):
    pool = Window.partitionBy("o_custkey")
    orders = _read(spark, d, "orders").withColumn("seen", F.when(F.col("o_orderstatus") != "P", _epoch("o_orderdate")))
    return orders.select("o_orderkey", scores.recency(F.col("seen"), pool).alias("recency"), scores.min_max(F.col("o_totalprice"), pool).alias("score"), text.path_relevance(F.lit("high urgent"), F.col("o_orderpriority")).alias("path"))


def recency(spark, d):
    return _scored(_order_signals(spark, d).select("o_orderkey", "recency"))


def three_signal(spark, d):
    s = _order_signals(spark, d)
    return _scored(s.select("o_orderkey", scores.three_signal(F.col("score"), F.col("recency"), F.col("path")).alias("score")))


# -- whole searches


def _registry(spark, d):
    """doc_id, blob_hash, path, branch of each document: texts are hashed once, what a search looks up is narrow."""
    return Scratch(spark, "registry").table(spread(_blobs(spark, d)).drop("content"), "blobs")


def _model(spark, d, registry=None):
    """Vectors of the contents whose document has an embedding."""
    v = _vectors(spark, d)
    entries = _blobs(spark, d) if registry is None else registry
    return entries.join(v, F.col("doc_id") == F.col("vec_id")).select("blob_hash", "q.q_min", "q.q_scale", "q.q_data")


def _search(spark, d, branch=None):
    entries = _registry(spark, d)
    limit = search.over_fetch(MODEL_K)
    members = None if branch is None else relational.on_branch(entries, branch)
    hits = vector_search.search(_model(spark, d, entries), _asked(spark, d), limit, members).select(F.lit(0).cast("long").alias("query_id"), "blob_hash", "score")
    keyword = fts.best(fts.bm25(*_keyword(spark, d, WORDS)), limit)
    queries = spark.createDataFrame([(0, WORDS + " src1")], "query_id long, text string")
    links = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_orderkey").alias("commit_hash"))
    links = links.join(entries.select("doc_id", "blob_hash"), "doc_id").select("blob_hash", "commit_hash")
    found = search.hybrid(queries, hits, keyword, entries.select("blob_hash", "path"), links, _commits(spark, d), MODEL_K, members)
    return _shown(found)


def _shown(found: DataFrame) -> DataFrame:
    return _scored(found.select("rank", "blob_hash", F.array_join("paths", "|").alias("paths"), "score", "provenance", "degraded"))


def search_hybrid(spark, d):
    return _search(spark, d)


def search_hybrid_branch(spark, d):
    return _search(spark, d, "src1")


def search_fts_only(spark, d):
    keyword = fts.best(fts.bm25(*_keyword(spark, d, WORDS)), MODEL_K)
    return _shown(search.keyword_only(keyword, _blobs(spark, d).select("blob_hash", "path"), MODEL_K))


def search_fts_only_branch(spark, d):
    keyword = fts.best(fts.bm25(*_keyword(spark, d, WORDS)), search.over_fetch(MODEL_K))
    blobs = _blobs(spark, d)
    return _shown(search.keyword_only(keyword, blobs.select("blob_hash", "path"), MODEL_K, relational.on_branch(blobs, "src1")))


def result_lines(spark, d):
    found = search_fts_only(spark, d)
    return found.select("rank", text.result_line(F.col("rank"), F.col("score"), F.replace("paths", F.lit("|"), F.lit(", ")), F.col("provenance"), F.col("blob_hash")).alias("line"))


def coverage(spark, d):
    known = _blobs(spark, d).agg(F.countDistinct("blob_hash").alias("known"))
    both = known.withColumn("embedded", _model(spark, d).agg(F.countDistinct("blob_hash")).scalar())
    return both.select("embedded", "known", F.round(scores.coverage_fraction(F.col("embedded"), F.col("known")), 6).alias("fraction"), scores.coverage_complete(F.col("embedded"), F.col("known")).alias("complete"))


def status(spark, d):
    last = _read(spark, d, "events").agg(F.max_by("event_id", F.struct("ts", "event_id"))).scalar()
    dims = _read(spark, d, "embeddings").agg(F.max(F.size("embedding"))).scalar()
    return coverage(spark, d).withColumn("last_indexed", last).withColumn("dimensions", dims)


# -- evaluation


def _cases(spark, d):
    """A case for each label: expected are the vectors whose first component is positive, retrieved the ten with the largest second one."""
    e = _read(spark, d, "embeddings").select("label", "vec_id", F.concat_ws("/", F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("path"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    cases = e.groupBy(F.col("label").cast("long").alias("case_id")).agg(F.collect_list(F.when(F.col("x") > 0, F.col("path"))).alias("expected_paths"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("y"), "vec_id"))
    matches = e.select(F.col("label").cast("long").alias("case_id"), rank.alias("rank"), F.array("path").alias("paths")).filter(F.col("rank") <= 10)
    return cases, matches


def eval_cases(spark, d):
    return _scored(evaluation.case_metrics(*_cases(spark, d)))


def eval_report(spark, d):
    return _scored(evaluation.report(evaluation.case_metrics(*_cases(spark, d))))


def eval_coverage(spark, d):
    runs = _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("embedded"), F.count("*").alias("known"), F.bool_or(F.col("o_orderstatus") == "P").alias("degraded"))
    return evaluation.least_coverage(runs)


# -- walks


def commit_range_walk(spark, d):
    """History of the last commit without that of its quarter; the parent of n is n div 2."""
    orders = _read(spark, d, "orders")
    edges = orders.select(F.col("o_orderkey").alias("child"), F.floor(F.col("o_orderkey") / 2).alias("parent"))
    tip = orders.agg(F.max("o_orderkey").alias("commit"))
    return walk.commit_range(edges, tip, tip.select(F.floor(F.col("commit") / 16).alias("commit")))


def commit_changes(spark, d):
    """Changes against the first parent: (path, content) of a commit that its parent does not have."""
    rows = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_linenumber").alias("path"), F.col("l_partkey").alias("blob")).distinct()
    parents = rows.select((F.col("commit") + 1).alias("commit"), "path", "blob")
    return rows.join(parents, ["commit", "path", "blob"], "left_anti")


_ALL = (
    blob_registry, paths_for_blob, branches_for, blobs_on_branch, blob_exists_semi, filter_new_blobs_anti, insert_or_ignore, first_seen, blob_commit_links, embed_config_latest,
    most_recent_ref, counts, count_for_model, vector_entry_for, content_for, last_commit_by_insert, oversized_tally, index_tally, git_blob_ids, latest_path_in_window, file_chunk_spans, fixed_chunks_1500, fixed_chunks_800, fallback_chain,
    quantized, dequantize_error, vector_topk, vector_topk_branch, vector_topk_chunks, path_relevance, quoted_queries, context_errors, fts_match, fts_bm25_nostem, fts_phrase, fts_porter,
    fts_vocabulary, minmax_norm, hybrid_blend, recency, three_signal, search_hybrid, search_hybrid_branch, search_fts_only, search_fts_only_branch, result_lines, coverage, status,
    eval_cases, eval_report, eval_coverage, commit_range_walk, commit_changes,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
