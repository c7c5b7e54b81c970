"""Mixing against SQL and against targets found by repeated sharing."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loreseek.llm import mixing
from tests.llm.conftest import edge_rows, prose


def shared_out(sizes: dict) -> dict:
    """Targets by sharing the excess again and again until no target is above twice its source's size."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        share = left / total
        left = 0.0
        for s in sorted(open_, key=order.index):
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 30}, {"a": 1, "b": 1000, None: 10}, {"x": 0, "y": 7}, {"a": 10, "b": 10, "c": 10, "d": 10, "e": 10}, {"only": 9}, {"Z": 50, "a": 3, "é": 4, None: 80}])
def test_targets(spark, sizes):
    found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    wanted = shared_out(sizes)
    assert {r["source"] for r in found} == set(sizes)
    for r in found:
        assert r["target"] == pytest.approx(wanted[r["source"]], abs=1e-6)


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "c", "d", "e", "f"]), st.integers(0, 500), min_size=1))
def test_targets_of_any_sizes(spark, sizes):
    found = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert found == pytest.approx(shared_out(sizes), abs=1e-6)


def corpus(make_docs, n=400):
    return make_docs([(k, prose(3 + k % 40, k) + (" !!! ###" if k % 9 == 0 else ""), "en", "hot" if k % 3 else f"s{k % 5}", 0) for k in range(n)])


def test_each_source_meets_its_target(make_docs):
    rows = mixing.decided(corpus(make_docs)).collect()
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_complete_epochs_precede_the_fraction(make_docs):
    for r in mixing.decided(corpus(make_docs)).collect():
        assert r["taken"] >= r["epochs"] * r["size"] and r["taken"] <= (r["epochs"] + 1) * r["size"]


def test_fraction_follows_the_keys(make_docs):
    by_source = defaultdict(list)
    for r in mixing.decided(corpus(make_docs)).collect():
        by_source[r["source"]].append(r)
    for rows in by_source.values():
        rows.sort(key=lambda r: (r["key"], r["doc_id"]))
        whole = [r["some"] == r["size"] for r in rows if r["size"]]
        assert whole == sorted(whole, reverse=True)
        assert sum(0 < r["some"] < r["size"] for r in rows) <= 1


def test_quality_weight_favours_clean_texts(spark):
    rows = spark.createDataFrame([("plain words",), ("## $$ %%",), ("",), (None,), ("half #### ####",)], "text string").select(mixing.quality_weight(mixing.F.col("text")).alias("w")).collect()
    plain, marks, empty, null, half = (r["w"] for r in rows)
    assert plain == 1.0 and marks == empty == null == 0.1 and 0.1 <= half < 1.0


def test_same_as_sql(edges, same_in_duckdb):
    same_in_duckdb(mixing.mix(edges), mixing.MIX_SQL, documents=edges.select("doc_id", "text", "source"))


def test_same_as_sql_on_a_hot_source(make_docs, same_in_duckdb):
    docs = corpus(make_docs)
    same_in_duckdb(mixing.mix(docs), mixing.MIX_SQL, documents=docs)


def test_parts_of_a_source_of_least_weight_are_small(spark, make_docs):
    """A junk source weighs 0.1, where parts of the uniform draw would put 43 % of it into the last one."""
    keys = spark.range(100_000).select(mixing.exponential_key(mixing.F.col("id"), mixing.F.lit(None).cast("string"), mixing.F.lit(0.1)).alias("key"))
    parts = keys.groupBy(mixing._part(mixing.F.log("key"), mixing.F.lit(mixing._FROM), mixing.F.lit(mixing._TO)).alias("part")).count()
    assert parts.agg(mixing.F.max("count")).first()[0] < 600


def test_same_as_sql_on_a_junk_source(make_docs, same_in_duckdb):
    docs = make_docs([(k if k % 7 else None, "### $$$ " * (1 + k % 5) + str(k % 90), "en", "junk" if k % 3 else "b", 0) for k in range(600)])
    same_in_duckdb(mixing.mix(docs), mixing.MIX_SQL, documents=docs)


def test_reruns_agree_however_rows_are_dealt(make_docs):
    docs = corpus(make_docs)
    runs = [sorted(map(str, mixing.mix(docs.repartition(n)).collect())) for n in (1, 6)]
    assert runs[0] == runs[1]


def test_mixed_rows(edges, make_docs):
    docs = corpus(make_docs)
    decided = {r["doc_id"]: r for r in mixing.decided(docs).collect()}
    times = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    for doc_id, r in decided.items():
        assert times[doc_id] == r["epochs"] + (2 * r["some"] >= r["size"] and r["some"] > 0)
    mixed = mixing.mixed(edges)
    assert mixed.columns == edges.columns and {r["doc_id"] for r in mixed.collect()} <= {r[0] for r in edge_rows()}


def test_empty(nothing):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
