"""Alike texts of the pipeline's near-duplicate stage against all pairs."""

from __future__ import annotations

import functools

import corpus_pipeline
import pytest
from loreseek.llm import nearcopies, simhash
from loreseek.sources.shared import Scratch
from tests.llm.conftest import edge_rows, prose
from tests.llm.test_simhash import groups, naive


def sets(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def linked(texts: list[str]) -> list[int]:
    """The first member of each text's group, by all pairs: 3 bits, or a similarity of 0.8."""
    label = groups([naive(t) for t in texts], 3)
    each = [sets(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            common = len(each[i] & each[j])
            if common >= 0.8 * (len(each[i]) + len(each[j]) - common) and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label


def changed() -> list[str]:
    """Texts and copies of them with one to eight of 250 words changed; some share a long passage only."""
    passage, out = prose(60, 999), []
    for k in range(40):
        words = prose(250, k).split()
        for n in range(6):
            copy = list(words)
            for c in range(n * (1 + k % 3)):
                copy[(31 * c + 7 * n) % 250] = f"w{k}x{n}x{c}"
            out.append(" ".join(copy))
        out.append(f"{passage} {prose(120, 500 + k)}")
    return out


@pytest.mark.parametrize("limits", [{}, {"stars": 0, "part": 3}, {"stars": 1, "part": 5}])
def test_stage_drops_all_alike_texts(spark, make_docs, monkeypatch, limits):
    monkeypatch.setattr(nearcopies, "join_alike", functools.partial(nearcopies.join_alike, **limits))
    texts = changed()
    label = linked(texts)
    assert len(set(label)) < len(set(groups([naive(t) for t in texts], 3)))  # 3 bits alone leave some
    docs = make_docs([(k, t, "en", "a", 0) for k, t in enumerate(texts)])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == sorted(set(label))


def test_stage_writes_few_tables_and_compares_few_sets(spark, make_docs, monkeypatch):
    written, whole = {}, Scratch.table

    def table(self, df, name):
        out = whole(self, df, name)
        written.setdefault(name, []).append(out.count() if name in ("sets", "one") else None)
        return out

    monkeypatch.setattr(Scratch, "table", table)
    texts = [*changed(), *(prose(250, 2000 + k) for k in range(200))]  # the last are like no other
    corpus_pipeline.drop_near_duplicates(spark, make_docs([(k, t, "en", "a", 0) for k, t in enumerate(texts)]), "").collect()
    assert sum(map(len, written.values())) <= 30
    assert 0 < written["sets"][0] <= written["one"][0] - 200


def test_large_group_of_near_copies(make_docs):
    words = prose(200, 5).split()
    texts = [" ".join([*words[: k % 190], f"v{k}", *words[k % 190 + 1 :]]) for k in range(300)]
    docs = make_docs([(k, t, "en", "a", 0) for k, t in enumerate(texts)])
    assert [r["doc_id"] for r in simhash.one_of_each(docs, 0, 0.8).collect()] == [0]


@pytest.mark.parametrize("text", ["", " \t", "a", "a b c d e", "a b c d e f", "A  b\nC d e F"])
def test_shingles(text):
    _, found = nearcopies.shingles(text.encode())
    assert len(found) == (len(sets(text)) if text.split() else 0)
    assert len(nearcopies.keys(found)) == (nearcopies.BANDS if len(found) else 0)
    assert nearcopies.shingles(text.upper().encode())[0] == nearcopies.shingles(text.encode())[0]


def test_edges(edges, nothing):
    kept = simhash.one_of_each(edges, similarity=0.8)
    assert kept.columns == edges.columns and 0 < kept.count() < len(edge_rows())
    assert simhash.one_of_each(nothing, similarity=0.8).count() == 0
