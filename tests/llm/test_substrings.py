"""Repeated strings against a scan of all windows."""

from __future__ import annotations

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loreseek.llm import substrings
from tests.llm.conftest import edge_rows, prose


def naive(rows: list[tuple], width: int) -> dict:
    """doc -> (n_bytes, n_removed, n_spans, kept hash); rows in the order of documents."""
    seen, out = set(), {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - width + 1):
            window = data[k : k + width]
            if window in seen:
                gone[k : k + width] = True
            seen.add(window)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    return out


def check(make_docs, texts: list[str], width: int, gram: int, **options) -> None:
    rows = list(enumerate(texts))
    docs = make_docs([(k, t, "en", "a", 0) for k, t in rows]).repartition(3)
    found = {r["doc_id"]: tuple(r)[1:] for r in substrings.remove_repeats(docs, width, gram, **options).collect()}
    assert found == naive(rows, width)


def shared(seed: int) -> list[str]:
    """Passages in various surroundings, copies, a run of one letter, and repeats within one text."""
    rng = np.random.default_rng(seed)
    passages = [prose(30, 100 + k) for k in range(4)]
    texts = []
    for k in range(24):
        parts = [prose(int(rng.integers(5, 40)), 1000 + 50 * seed + k)]
        for _ in range(int(rng.integers(0, 4))):
            p = passages[int(rng.integers(4))]
            a = int(rng.integers(0, 40))
            parts += [p[a : a + int(rng.integers(60, 200))], prose(int(rng.integers(1, 20)), 3000 + k)]
        texts.append(" ".join(parts))
    return [*texts, texts[0], texts[1] + texts[1], "x" * 700, "xy" * 300, "x" * 150, "", "short", texts[2][:100], texts[2][50:], "é日😀" * 60]


@pytest.mark.parametrize("seed", range(3))
def test_whole_width(make_docs, seed):
    check(make_docs, shared(seed), 100, 32)


@pytest.mark.parametrize(("width", "gram"), [(64, 32), (20, 10), (8, 4)])
def test_other_widths(make_docs, width, gram):
    check(make_docs, shared(7), width, gram)


def test_hot_buckets_are_dealt_by_windows(make_docs):
    """A bucket of more texts than a block holds goes the other way, with the same result."""
    check(make_docs, shared(4), 100, 32, block=3)


def test_one_passage_in_most_documents(make_docs):
    passage = prose(60, 77)
    check(make_docs, [f"{prose(8, k)} {passage} {prose(8, 900 + k)}" if k % 3 else prose(30, k) for k in range(120)], 100, 32, block=16)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6))
def test_small_alphabet_without_spark(texts):
    """The blocks' sorting alone: windows of a bucket are told apart by two ranks."""
    width, gram = 8, 4
    data = [t.encode() for t in texts]
    flat = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.cumsum([0, *map(len, data)])
    own, first, many, away, names = substrings.cover(flat, offsets, width, gram)
    covered = sorted((int(o), int(f - offsets[o] + k)) for o, f, m in zip(own, first, many, strict=True) for k in range(m))
    assert covered == [(d, k) for d, t in enumerate(data) for k in range(len(t) - width + 1)]
    if len(own):
        order = np.lexsort((first, own))
        own, first, many, away, names = (x[order] for x in (own, first, many, away, names))
        pieces = [bytes(flat[f : f + m - 1 + width]) for f, m in zip(first, many, strict=True)]
        again = substrings.repeated_windows(np.unique(names, return_inverse=True)[1], away, many, pieces, width, gram)
        seen = set()
        for k, piece in enumerate(pieces):
            for w in range(int(many[k])):
                window = piece[w : w + width]
                assert again[k, away[k] - w] == (window in seen)
                # Equal windows of one record start at different distances from its sample only if they sample twice.
            seen.update(piece[w : w + width] for w in range(int(many[k])))


def test_long_texts_are_cut_into_segments(make_docs, monkeypatch):
    texts = [prose(3000, 1), prose(2000, 2) + prose(3000, 1)[5000:9000], "z" * 9000]
    flat = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = substrings.cover(flat, offsets)
    monkeypatch.setattr(substrings, "SEGMENT", 2000)
    parts = substrings.cover(flat, offsets)
    windows = lambda c: sorted((int(f) + k, int(a) - k) for _, f, m, a, _ in zip(*c, strict=True) for k in range(m))
    assert [w for w, _ in windows(whole)] == [w for w, _ in windows(parts)] and len(windows(whole)) == sum(len(t) - 99 for t in texts)


def traced_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_a_worker_is_bounded():
    """Two workers share an executor with its JVM, and keep much of what they once needed."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 2000, dtype=np.uint8)).decode() for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(texts)], names=["doc", "text"])
    assert traced_mb(lambda: [b.num_rows for b in substrings._records(iter([batch]), 100, 32)]) < 120
    n = 42000
    names = np.sort(rng.integers(0, n // 4, n))
    around = pa.array([bytes(rng.integers(97, 99, 150, dtype=np.uint8)) for _ in range(n)], pa.binary())
    rows = pa.table({"h": names, "doc": np.arange(n), "at": np.full(n, 30 << 8 | 51), "text": around}).to_batches(max_chunksize=10000)
    assert traced_mb(lambda: [b.num_rows for b in substrings._blocks(iter(rows), 100, 32)]) < 90


def test_edges(edges, nothing):
    rows = substrings.remove_repeats(edges).collect()
    assert len(rows) == len(edge_rows())
    # Null ids last; equal rows are one document, and each gets its result.
    order = sorted({(r[0], r[1]) for r in edge_rows()}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    wanted = naive([((d, t), t) for d, t in order], 100)
    assert sorted(str((r["doc_id"], *tuple(r)[1:])) for r in rows) == sorted(str((d, *wanted[d, t])) for d, t, *_ in edge_rows())
    assert substrings.remove_repeats(nothing).count() == 0


def test_widths_out_of_range_are_refused(nothing):
    with pytest.raises(ValueError):
        substrings.remove_repeats(nothing, 40, 32)


def test_same_as_sql(edges, make_docs, same_in_duckdb):
    docs = edges.select("doc_id", "text").filter("doc_id is null or doc_id <> 6")  # the long text is held against the scan above
    rows = [(k, t) for k, t in enumerate(shared(9))]
    docs = docs.unionByName(make_docs([(100 + k, t, "en", "a", 0) for k, t in rows]).select("doc_id", "text"))
    same_in_duckdb(substrings.remove_repeats(docs), substrings.REPEATS_SQL, documents=docs)
