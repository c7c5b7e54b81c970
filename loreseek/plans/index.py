"""The index of one history: incremental indexing, search, status, evaluation."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreseek.functions.chunking import Chunker
from loreseek.functions.embedding import Provider, embed_all
from loreseek.functions.hashing import utf16_length
from loreseek.functions.scores import BM25_WEIGHT, Weights
from loreseek.functions.vectors import quantize
from loreseek.operators import evaluation, fts, vector_search
from loreseek.operators.fallback import embed_with_fallback
from loreseek.operators.relational import entry_for, filter_new, last_by_insert, on_branch
from loreseek.plans import search as plans
from loreseek.schemas import MATCHES
from loreseek.sources import git
from loreseek.sources.shared import Scratch, remove
from loreseek.sources.store import Store

MAX_BLOB_BYTES = 200 * 1024
CASES = 1_000  # queries that one plan answers
WINDOW = 100_000  # new contents that are fetched, embedded and written at a time


class Cancelled(Exception):
    """The run was stopped between two windows; what they wrote stays, the cursor is as it was."""


class Repository(Protocol):
    """Where histories come from."""

    def commits(self, spark: SparkSession, ref: str, since: str | None) -> DataFrame: ...
    def blobs(self, spark: SparkSession, ref: str, since: str | None) -> DataFrame: ...
    def with_content(self, entries: DataFrame, max_bytes: int) -> DataFrame: ...


class GitRepository:
    def __init__(self, path: str) -> None:
        self.path = path

    def commits(self, spark: SparkSession, ref: str, since: str | None) -> DataFrame:
        return git.stream_commits(spark, self.path, ref, since)

    def blobs(self, spark: SparkSession, ref: str, since: str | None) -> DataFrame:
        return git.stream_blobs(spark, self.path, ref, since)

    def with_content(self, entries: DataFrame, max_bytes: int) -> DataFrame:
        return git.with_content(entries, self.path, max_bytes)


@dataclass(frozen=True)
class Query:
    text: str
    top_k: int = 10
    branch: str | None = None


@dataclass(frozen=True)
class Coverage:
    embedded: int
    known: int

    @property
    def fraction(self) -> float:
        return self.embedded / self.known if self.known else 0.0

    @property
    def complete(self) -> bool:
        return 0 < self.known <= self.embedded


@dataclass(frozen=True)
class SearchResult:
    matches: DataFrame
    coverage: Coverage
    degraded: bool


@dataclass(frozen=True)
class Status:
    coverage: Coverage
    last_indexed_commit: str | None
    model: str | None
    dimensions: int | None


@dataclass(frozen=True)
class IndexResult:
    commits: int
    seen: int
    indexed: int
    skipped: int
    failed: int
    oversized: int


@dataclass(frozen=True)
class EvalReport:
    k: int
    cases: DataFrame
    count: int
    precision: float
    recall: float
    mrr: float
    coverage: Coverage
    degraded: bool


class HistoryIndex:
    """An index below ``path``. The provider, chunker, weights and limits are the caller's.

    Order of writes: registry, keyword index and blobs, then vectors, then the cursor; so a run that
    breaks off leaves nothing that counts as embedded but can't be found, and the next run starts
    from the old cursor. Cursors belong to a ref and a model.
    """

    def __init__(self, spark: SparkSession, path: str, provider: Provider, repository: Repository | None = None, *, chunker: Chunker | None = None, concurrency: int = 4, batch_size: int = 1, max_blob_bytes: int = MAX_BLOB_BYTES, window: int = WINDOW, weights: Weights = Weights(), bm25_weight: float = BM25_WEIGHT, over_fetch: int = plans.OVER_FETCH, least_fetch: int = plans.LEAST_FETCH, clock: Callable[[], int] = lambda: int(time.time())) -> None:
        self.spark, self.store, self.provider, self.repository = spark, Store(spark, path), provider, repository
        self.chunker, self.concurrency, self.batch_size, self.max_blob_bytes, self.window = chunker, concurrency, batch_size, max_blob_bytes, window
        self.weights, self.bm25_weight, self.over, self.least, self.clock = weights, bm25_weight, over_fetch, least_fetch, clock

    # -- indexing

    def cursor(self, ref: str) -> str | None:
        row = self.store.read("resume_cursor").filter((F.col("ref") == ref) & (F.col("model") == self.provider.model)).select("commit_hash").first()
        return row[0] if row else None

    def register_commits(self, commits: DataFrame) -> None:
        """Commits, links and paths of ``commits``; writing the same commits again changes nothing."""
        now = F.lit(self.clock()).cast("long")
        self.store.insert_or_ignore("commit_entry", commits.select(F.col("hash").alias("commit_hash"), "timestamp", "author_name", "author_email", "message"))
        changed = commits.select("hash", F.explode("changed_blobs").alias("c")).select(F.col("hash").alias("commit_hash"), "c.blob_hash", "c.path")
        self.store.insert_or_ignore("blob_commit_entry", changed)
        self.store.insert_or_ignore("path_entry", changed)
        self.store.insert_or_ignore("indexed_commit_entry", commits.select(F.col("hash").alias("commit_hash"), now.alias("indexed_at")))

    def index(self, ref: str = "HEAD", since: str | None = None, progress: Callable[[str, int], None] = lambda what, n: None, cancelled: Callable[[], bool] = lambda: False) -> IndexResult:
        """Indexes what ``ref`` reaches and the cursor, or ``since``, does not.

        progress is told the commits once, then after each window how many contents were embedded so far. cancelled is
        asked before each window; True ends the run with ``Cancelled``.
        """
        if self.repository is None:
            raise ValueError("this index has no repository to walk")
        since = since or self.cursor(ref)
        with self._stage() as keep:
            self._check(cancelled)
            commits = keep(self.repository.commits(self.spark, ref, since).withColumn("walk", F.monotonically_increasing_id()), "commits")
            count, tip = commits.agg(F.count("*"), F.min_by("hash", "walk")).first()
            self.register_commits(commits)
            progress("commits", count)
            self._check(cancelled)
            seq, tallies = self._index_entries(keep(self.repository.blobs(self.spark, ref, since), "blobs"), ref, keep, progress, cancelled)
            if count:
                cursor = self.spark.createDataFrame([(ref, self.provider.model, tip, self.clock())], "ref string, model string, commit_hash string, updated_at long")
                self.store.replace("resume_cursor", cursor, seq)
        return IndexResult(count, *tallies)

    def index_changes(self, commits: DataFrame, ref: str) -> IndexResult:
        """Registers ``commits`` and indexes the contents that they brought in; the cursor stays, as a stream has its own."""
        with self._stage() as keep:
            commits = keep(commits, "commits")
            count = commits.count()
            self.register_commits(commits)
            changed = commits.select(F.posexplode("changed_blobs").alias("walk_order", "c")).select("c.path", "c.blob_hash", F.col("walk_order").cast("long").alias("walk_order"))
            _, tallies = self._index_entries(keep(changed, "blobs"), ref, keep)
        return IndexResult(count, *tallies)

    @contextmanager
    def _stage(self) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
        """A function that writes a frame under a name and reads it back; the tables go with the run, however it ends."""
        stage = f"{self.store.path}/_stage/{uuid.uuid4().hex}"

        def keep(df: DataFrame, name: str) -> DataFrame:
            schema = df.schema
            df.write.parquet(f"{stage}/{name}")
            return self.spark.read.schema(schema).parquet(f"{stage}/{name}")

        try:
            yield keep
        finally:
            remove(self.spark, stage)

    @staticmethod
    def _check(cancelled: Callable[[], bool]) -> None:
        if cancelled():
            raise Cancelled

    def _index_entries(self, entries: DataFrame, ref: str, keep: Callable[[DataFrame, str], DataFrame], progress: Callable[[str, int], None] = lambda what, n: None, cancelled: Callable[[], bool] = lambda: False) -> tuple[int, tuple[int, ...]]:
        """The number of the run's versions, and (seen, indexed, skipped, failed, oversized), of written ``entries`` (path, blob_hash, walk_order)."""
        store, model = self.store, self.provider.model
        config = store.read("embed_config_entry").filter(F.col("model") == model).first()
        if config and config["dimensions"] != self.provider.dimensions:
            raise ValueError(f"model '{model}' is indexed with {config['dimensions']} dimensions, not {self.provider.dimensions}")
        seq = store.next_seq()
        row = (model, type(self.provider).__name__, self.provider.dimensions, "file", self.clock())
        store.replace("embed_config_entry", self.spark.createDataFrame([row], "model string, provider string, dimensions int, chunker string, last_used_at long"), seq)
        seen = entries.count()
        store.insert_or_ignore("blob_branch_entry", entries.select("blob_hash", F.lit(ref).alias("branch")))
        present = store.raw("vector_entry").filter(F.col("model") == model)
        one_path = entries.groupBy("blob_hash").agg(F.max_by("path", "walk_order").alias("path"))
        fresh = keep(filter_new(one_path, present, "blob_hash"), "fresh")
        wanted = fresh.count()
        windows = math.ceil(wanted / self.window)
        indexed = failed = oversized = 0
        for k in range(windows):
            self._check(cancelled)
            part = fresh.filter(F.pmod(F.xxhash64("blob_hash"), F.lit(windows)) == k)
            done = self._index_window(part, seq, lambda df, name, k=k: keep(df, f"{name}-{k}"))
            indexed, failed, oversized = (a + b for a, b in zip((indexed, failed, oversized), done, strict=True))
            progress("blobs", indexed)
        return seq, (seen, indexed, seen - wanted, failed, oversized)

    def _index_window(self, entries: DataFrame, seq: int, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[int, int, int]:
        """Fetches, embeds and writes the contents of ``entries`` (blob_hash, path): how many were indexed, failed, and were too large."""
        store = self.store
        fetched = keep(self.repository.with_content(entries, self.max_blob_bytes), "fetched")
        oversized = fetched.filter("content is null").count()
        texts = fetched.filter("content is not null")
        vectors, failed = embed_with_fallback(texts.select("blob_hash", "content"), self.provider, keep, self.batch_size, self.concurrency, self.chunker)
        done = keep(vectors.select("blob_hash", "chunk_index", F.lit(self.provider.model).alias("model"), quantize(F.col("vector")).alias("q")), "vectors")
        good = texts.join(done.select("blob_hash").distinct(), "blob_hash", "left_semi")
        indexed, missed = done.select("blob_hash").distinct().count(), failed.count()
        store.insert_or_ignore("path_entry", good.select("blob_hash", "path"))
        self.index_texts(good.select("blob_hash", "content"), seq)
        store.insert_or_ignore("blob_entry", good.select("blob_hash", utf16_length(F.col("content")).cast("long").alias("size"), F.lit(self.clock()).cast("long").alias("indexed_at")))
        store.insert_or_ignore("vector_entry", done.select("blob_hash", "model", "chunk_index", "q.q_min", "q.q_scale", "q.q_data"))
        return indexed, missed, oversized

    def index_texts(self, docs: DataFrame, seq: int | None = None) -> None:
        """Adds texts (blob_hash, content) to the keyword index, replacing those that are there."""
        seq = self.store.next_seq() if seq is None else seq
        docs = docs.dropDuplicates(["blob_hash"])
        self.store.replace("blob_content", docs, seq)
        postings, lengths = fts.build(docs)
        self.store.replace("fts_postings", postings, seq)
        self.store.replace("fts_doc_len", lengths, seq)

    # -- search

    def coverage(self) -> Coverage:
        embedded = self.store.raw("vector_entry").filter(F.col("model") == self.provider.model).agg(F.countDistinct("blob_hash")).first()[0]
        return Coverage(embedded, self.store.raw("blob_entry").count())

    def keyword_hits(self, queries: DataFrame, texts: list[str], limit: int) -> DataFrame:
        """query_id, blob_hash, bm25. The terms, known here, are pushed to the scan; a document's version is checked on what they leave."""
        lengths = self.store.raw("fts_doc_len")
        newest = lengths.groupBy("blob_hash").agg(F.max("_seq").alias("_seq"))
        current = lengths.join(newest, ["blob_hash", "_seq"])
        terms = sorted({t for text in texts for t in fts.tokens_of(text)})
        postings = self.store.raw("fts_postings").filter(F.col("term").isin(terms)).join(newest, ["blob_hash", "_seq"]).drop("_seq")
        return fts.best(fts.bm25(postings, current.drop("_seq"), fts.phrase_terms(queries)), limit)

    def search(self, query: Query) -> SearchResult:
        matches, coverage, degraded = self.search_many([query.text], query.top_k, query.branch)
        return SearchResult(matches.select(*[x.split()[0] for x in MATCHES.split(", ")]), coverage, degraded)

    def search_many(self, texts: list[str], top_k: int = 10, branch: str | None = None) -> tuple[DataFrame, Coverage, bool]:
        """Matches of all texts in one plan (query_id, rank, ...), the coverage, and whether vectors were missing.

        Without vectors of the model, or without an answer of its endpoint, the search is by keywords only.
        """
        coverage = self.coverage()
        queries = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
        members = None if branch is None else on_branch(self.store.raw("blob_branch_entry"), branch)
        outcomes = embed_all(self.provider, texts, self.batch_size) if coverage.embedded else []
        paths = self.store.raw("path_entry")
        if not outcomes or any(error for _, error in outcomes):
            limit = plans.over_fetch(top_k, self.over, self.least) if branch is not None else top_k
            return plans.keyword_only(self.keyword_hits(queries, texts, limit), paths, top_k, members), coverage, True
        limit = plans.over_fetch(top_k, self.over, self.least)
        vectors = self.store.raw("vector_entry").filter(F.col("model") == self.provider.model)
        vector_hits = vector_search.search_many(vectors, [(k, v) for k, (v, _) in enumerate(outcomes)], limit, members)
        found = plans.hybrid(queries, vector_hits, self.keyword_hits(queries, texts, limit), paths, self.store.raw("blob_commit_entry"), self.store.raw("commit_entry"), top_k, members, self.weights, self.bm25_weight)
        return found, coverage, False

    def vector_entry(self, blob_hash: str) -> DataFrame:
        """The chunks' vectors of one content, for this model."""
        return entry_for(self.store.raw("vector_entry"), model=self.provider.model, blob_hash=blob_hash)

    def content(self, blob_hash: str) -> str | None:
        """The text that the keyword index holds for a content, in its latest version."""
        row = last_by_insert(entry_for(self.store.raw("blob_content"), blob_hash=blob_hash), "content", "_seq").first()
        return row and row["content"]

    def last_inserted_commit(self) -> str | None:
        """The commit that was registered last, ties by hash."""
        return last_by_insert(self.store.raw("indexed_commit_entry"), "commit_hash", "indexed_at", "commit_hash").first()[0]

    def status(self) -> Status:
        """Coverage, the cursor of the ref that was indexed last, and the model's settings."""
        last = self.store.read("resume_cursor").agg(F.max_by("commit_hash", "updated_at")).first()[0]
        config = self.store.read("embed_config_entry").filter(F.col("model") == self.provider.model).first()
        return Status(self.coverage(), last, config and config["model"], config and config["dimensions"])

    def evaluate(self, cases: DataFrame, k: int = 10) -> EvalReport:
        """Metrics of ``cases`` (query, expected_paths); a block of ``CASES`` is searched in one plan."""
        if k < 1:
            raise ValueError(f"k must be at least 1, not {k}")
        scratch = Scratch(self.spark, "evaluation")
        rest, parts, coverage, degraded = cases.toLocalIterator(), [], Coverage(0, 0), False
        while block := list(islice(rest, CASES)):  # the driver embeds and holds one block of queries at a time
            first = len(parts) * CASES
            numbered = self.spark.createDataFrame([(first + n, r["expected_paths"]) for n, r in enumerate(block)], "case_id long, expected_paths array<string>")
            found, coverage, missing = self.search_many([r["query"] for r in block], k)
            degraded |= missing
            metrics = evaluation.case_metrics(numbered, found.select((F.col("query_id") + first).alias("case_id"), "rank", "paths"))
            parts.append(scratch.table(metrics, str(len(parts))))
        if not parts:
            none = [self.spark.createDataFrame([], shape) for shape in ("case_id long, expected_paths array<string>", "case_id long, rank int, paths array<string>")]
            return EvalReport(k, evaluation.case_metrics(*none), 0, 0.0, 0.0, 0.0, coverage, degraded)
        metrics = reduce(DataFrame.union, parts)
        total = evaluation.report(metrics).first()
        return EvalReport(k, metrics, total["cases"], total["precision"], total["recall"], total["mrr"], coverage, degraded)
