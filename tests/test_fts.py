"""Keyword search against the full-text index of the sqlite library."""

from __future__ import annotations

import sqlite3
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loreseek.functions import porter
from loreseek.functions.porter import stem
from loreseek.operators import fts
from loreseek.sources import shared

DOCS = {
    "a": "unique marker one running runs",
    "b": "unique marker two ran",
    "c": "marker one unique",
    "d": "café Ünïcode CAFÉ running",
    "e": "x unique_marker-one y",
    "f": "",
    "g": "the quick brown foxes were happily jumping over the relational databases " * 3,
    "h": "one one one unique unique",
}
QUERIES = ["run", "unique-marker-one", "unique one", "---", "unique ---", "café", "CAFÉ", "marker", "absent", "one one", "Relational DATABASE", "jump over", "the-quick", 'quo"ted', "happy", "one-one"]


@pytest.fixture(scope="module")
def library():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(blob_hash UNINDEXED, content, tokenize='porter ascii')")
    con.executemany("INSERT INTO t VALUES (?, ?)", DOCS.items())

    def search(query: str) -> dict[str, float]:
        quoted = " ".join('"' + q.replace('"', '""') + '"' for q in query.split())
        return dict(con.execute("SELECT blob_hash, bm25(t) FROM t WHERE t MATCH ?", (quoted,)).fetchall())

    return search


@pytest.fixture(scope="module")
def index(spark):
    postings, lengths = fts.build(spark.createDataFrame(list(DOCS.items()), "blob_hash string, content string"))
    return postings.cache(), lengths.cache()


def test_scores_as_in_the_library(spark, index, library):
    terms = fts.phrase_terms(spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string"))
    found: dict[int, dict] = {k: {} for k in range(len(QUERIES))}
    for r in fts.bm25(*index, terms).collect():
        found[r["query_id"]][r["blob_hash"]] = r["bm25"]
    for k, query in enumerate(QUERIES):
        assert found[k] == pytest.approx(library(query), rel=1e-9), query


def test_empty_query_finds_nothing(spark, index):
    terms = fts.phrase_terms(spark.createDataFrame([(0, ""), (1, "   ")], "query_id long, text string"))
    assert fts.bm25(*index, terms).count() == 0


def test_best_breaks_ties_by_hash(spark):
    rows = spark.createDataFrame([(0, h, -1.0) for h in "dcba"] + [(0, "z", -2.0), (1, "q", 0.0)], "query_id long, blob_hash string, bm25 double")
    assert sorted((r["query_id"], r["blob_hash"]) for r in fts.best(rows, 3).collect()) == [(0, "a"), (0, "b"), (0, "z"), (1, "q")]


def test_wanted_terms_only(spark, index):
    docs = spark.createDataFrame(list(DOCS.items()) * 2, "blob_hash string, content string")
    some, lengths = fts.build_for(docs, fts.tokens_of("running one"))
    assert sorted(map(tuple, lengths.collect())) == sorted(map(tuple, index[1].collect()))
    wanted = index[0].filter("term in ('run', 'on')").select(*some.columns)
    assert sorted(map(str, some.collect())) == sorted(map(str, wanted.collect()))


WORDS = "running runs ran relational conditional ponies caresses cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators yes by a is logi analogi ies eed ing ed sses y".split()


def test_stems_as_in_the_library():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter ascii')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(WORDS))
    wanted = dict(con.execute("SELECT doc, term FROM v").fetchall())
    assert {k: stem(w) for k, w in enumerate(WORDS)} == wanted


def test_stems_hold_the_words_of_a_piece():
    """Two million words of a few thousand kinds are stemmed without an object for each; long runs are not kept."""
    kinds = [f"{a}{b}ings" for a in "abcdefghij" for b in range(300)]
    lists = pa.array([kinds] * 700 + [[], ["ponies", "x" * 65]])
    porter._stem.cache_clear()
    tracemalloc.start()
    found = fts.stems(lists)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 << 20
    assert porter._stem.cache_info().currsize == len(kinds) + 1
    assert found[3].as_py() == [porter.stem(w) for w in kinds] and found[700].as_py() == [] and found[701].as_py() == ["poni", "x" * 65]
    assert fts.stems(lists.slice(699, 3)).to_pylist() == found.slice(699, 3).to_pylist() and len(found) == 702
    assert fts.stems(lists.slice(0, 0)).to_pylist() == []


def test_batches_of_texts_to_stem_are_bounded(spark, monkeypatch):
    before = spark.conf.get(shared._BATCH, None)
    spark.conf.unset(shared._BATCH)
    monkeypatch.setattr(fts, "tokens", lambda text, stem: F.arrow_udf(lambda x: pa.array([["w"] * len(x)] * len(x)), "array<string>")(text))
    docs = spark.range(0, 3000, 1, 1).selectExpr("cast(id as string) blob_hash", "repeat('x', 20000) content")
    try:
        for of in (fts.build, lambda d: fts.build_for(d, ["w"])):
            spark.conf.unset(shared._BATCH)
            assert of(docs)[1].agg(F.max("dl")).first()[0] < 500
    finally:
        spark.conf.set(shared._BATCH, before) if before else spark.conf.unset(shared._BATCH)
