"""Best-fit packing against its definition, replayed step by step."""

from __future__ import annotations

from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from loreseek.llm.packing import pack, pack_documents
from tests.llm.conftest import edge_rows, prose

PAIRS = (("a", "b"), ("c", "d"))


def conflict(x, y) -> bool:
    return tuple(sorted((str(x[1]), str(y[1])))) in PAIRS or x[2] is not None and x[2] == y[2]


def replay(rows, bins, capacity) -> None:
    """Each piece, largest first, went to a compatible bin with the least residual, or to a new one if there was none."""
    held: dict[int, list] = {}
    for k in sorted(range(len(rows)), key=lambda k: (-rows[k][0], k)):
        row = rows[k]
        fits = {b: capacity - sum(x[0] for x in v) for b, v in held.items() if not any(conflict(row, x) for x in v)}
        fits = {b: r for b, r in fits.items() if r >= row[0]}
        if fits:
            assert fits.get(bins[k]) == min(fits.values())
        else:
            assert bins[k] not in held
        held.setdefault(bins[k], []).append(row)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.sampled_from(["a", "b", "c", "d", None]), st.sampled_from([1, 2, 3, None])), max_size=40))
def test_each_piece_goes_to_the_tightest_compatible_bin(rows):
    replay(rows, pack(rows, 20, PAIRS), 20)


def test_search_goes_on_past_tighter_bins_that_conflict():
    rows = [(15, "a", 1), (12, "c", 2), (5, "b", 3), (5, "b", 1)]
    assert pack(rows, 20, PAIRS) == [0, 1, 1, 2]


def test_documents(spark, edges):
    found = pack_documents(edges, capacity=50, shard=5, apart=PAIRS).collect()
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"], r["size"]].append(r)
    sizes = sorted(((r[0], len((r[1] or "").split())) for r in edge_rows()), key=str)
    assert sorted({k for k in by_doc}, key=str) == sorted(set(sizes), key=str)
    for (_, size), rows in by_doc.items():
        copies = sum(1 for r in rows if r["piece"] == 0)
        assert sum(r["words"] for r in rows) == size * copies
        assert {(r["start"], r["words"]) for r in rows} == {(p, min(50, size - p)) for p in range(0, max(size, 1), 50)}
    bins = defaultdict(list)
    for r in found:
        bins[r["shard"], r["bin"]].append(r)
    for rows in bins.values():
        assert sum(r["words"] for r in rows) <= 50
        assert not any(tuple(sorted((str(x["source"]), str(y["source"])))) in PAIRS for x in rows for y in rows)
        assert all(len(rows) == 1 and r["words"] == 50 for r in rows if r["full"])


def test_copies_of_a_cluster_are_kept_apart(make_docs):
    docs = make_docs([(k, "Same text here" if k % 2 else "same TEXT here", "en", "a", 0) for k in range(30)])
    found = pack_documents(docs, capacity=50, shard=1000).collect()
    assert len({r["bin"] for r in found}) == len(found) == 30


def test_large_group_of_copies_spreads_over_shards(make_docs):
    docs = make_docs([(k, prose(10, 1) if k % 3 else prose(10, k), "en", "hot", 0) for k in range(600)])
    found = pack_documents(docs, capacity=100, shard=50).collect()
    assert len(found) == 600
    sizes = defaultdict(int)
    for r in found:
        sizes[r["shard"]] += 1
    assert len(sizes) == 12 and max(sizes.values()) < 120


def test_bins_do_not_depend_on_the_layout(make_docs):
    rows = [(k % 450 if k % 9 else None, prose(k % 40, k % 450), "en", "abc"[k % 3], 0) for k in range(900)] + [(7, "same row", "en", "a", 0)] * 300
    shown = lambda n: sorted(map(str, pack_documents(make_docs(rows).repartition(n), capacity=100, shard=50, apart=PAIRS).collect()))
    assert shown(1) == shown(3) == shown(7)
    spread = {r["shard"] for r in pack_documents(make_docs(rows), capacity=100, shard=50).collect() if r["doc_id"] == 7}
    assert len(spread) >= 5


def test_reruns_agree_and_empty_table(make_docs, nothing):
    docs = make_docs([(k, prose(k % 17, k), "en", "abc"[k % 3], 0) for k in range(200)]).coalesce(2)
    assert sorted(map(str, pack_documents(docs).collect())) == sorted(map(str, pack_documents(docs).collect()))
    assert pack_documents(nothing).count() == 0
