"""The pipeline against its stages done by hand."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loreseek.llm import pii, quality
from tests.llm.conftest import CLASHING, edge_rows, prose
from tests.llm.test_mixing import shared_out
from tests.llm.test_quality import junk
from tests.llm.test_simhash import groups, naive

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows():
    out = []
    for k in range(240):
        text = junk(k) if k % 5 == 0 else prose(60 + k % 200, k)
        if k % 7 == 1:
            text += f" mail me{k}@example.org or jane [at] example [dot] org"
        out.append((k, text, "en", "hot" if k % 3 else f"src{k % 4}", len(text)))
    out += [(1000 + k, out[4 + 5 * k][1].upper() if k % 2 else out[4 + 5 * k][1], "en", "src1", 0) for k in range(8)]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, make_docs):
    path = str(tmp_path_factory.mktemp("pipeline"))
    make_docs(rows()).coalesce(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(240)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows before and after each stage, each written and read again."""
    path = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, docs, sf_dir)
        if k < 4:
            assert df.columns == COLUMNS
        df.write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        out.append(docs.collect())
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "personal data", "mixing to target weights", "best-fit packing"]


def test_classifier_keeps_what_it_predicts(spark, sf_dir, stages):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in stages[1]} == good
    assert all(r["doc_id"] % 5 != 0 or r["doc_id"] >= 1000 for r in stages[1]) and len(good) > 185


def test_one_of_each_group_stays(stages):
    before = sorted(stages[1], key=lambda r: r["doc_id"])
    label = groups([naive(r["text"]) for r in before], 3)
    assert sorted(stages[2]) == sorted(before[k] for k in set(label))
    assert all(r["doc_id"] < 1000 for r in stages[2])


def test_personal_data_is_masked(stages):
    before = {r["doc_id"]: r for r in stages[2]}
    assert len(stages[3]) == len(before)
    for r in stages[3]:
        text = pii.mask(before[r["doc_id"]]["text"])
        assert r == (r["doc_id"], text, "en", before[r["doc_id"]]["source"], len(text))
    assert any("<EMAIL>" in r["text"] for r in stages[3])


def test_mix_meets_the_targets(stages):
    sizes, taken = Counter(), Counter()
    longest = defaultdict(int)
    for r in stages[3]:
        n = len(r["text"].split())
        sizes[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    for r in stages[4]:
        taken[r["source"]] += len(r["text"].split())
    target = shared_out(sizes)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)
    assert set(stages[4]) <= set(stages[3]) and max(Counter(r["doc_id"] for r in stages[4]).values()) <= 2


def test_bins_hold_all_words_of_the_mix(stages):
    words = Counter()
    for r in stages[4]:
        words[r["doc_id"]] += len(r["text"].split())
    packed, bins = Counter(), defaultdict(list)
    for r in stages[5]:
        packed[r["doc_id"]] += r["words"]
        bins[r["shard"], r["bin"]].append(r)
    assert +packed == +words
    for held in bins.values():
        assert sum(r["words"] for r in held) <= 2048
        assert max(Counter(r["doc_id"] for r in held).values()) == 1  # copies are kept apart


def test_run_is_the_stages(spark, sf_dir, stages):
    shown = lambda rows: sorted(str((r["doc_id"], r["source"], r["size"], r["piece"], r["words"])) for r in rows)
    assert shown(corpus_pipeline.run(spark, sf_dir).collect()) == shown(stages[5])


def test_edges_and_extra_columns(spark, sf_dir, make_docs, tmp_path):
    docs = make_docs(edge_rows()).withColumns({c: F.lit(1) for c in CLASHING})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, docs, sf_dir)
        df.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() > 0


def test_empty_tables(spark, tmp_path, nothing):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
