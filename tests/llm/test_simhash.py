"""SimHash groups against all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from loreseek.llm import simhash
from loreseek.llm.common import connected_components
from loreseek.sources.shared import Scratch
from tests.llm.conftest import edge_rows, prose


def naive(text: str | None) -> int:
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def groups(fps: list[int], radius: int) -> list[int]:
    """The index of the first member of each one's component, by all pairs."""
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None]) <= radius
    label = np.arange(len(x))
    while True:
        after = np.where(near, label[None, :], len(x)).min(axis=1)
        if (after == label).all():
            return label.tolist()
        label = after


def test_fingerprint():
    for r in edge_rows():
        assert simhash.fingerprint((r[1] or "").encode()) == naive(r[1])
    assert simhash.fingerprint("a b".encode()) == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint("A B Ä".encode()) == naive("A B Ä")


def near_texts() -> list[tuple]:
    rows = []
    for k in range(60):
        words = prose(300, k).split()
        for n in range(1 + k % 4):
            words[(17 * n) % 300] = f"w{n}"
            rows.append((len(rows), " ".join(words), "en", "a", 0))
    return [*rows, (9000, rows[0][1], "en", "a", 0), (9001, rows[0][1].upper(), "en", "a", 0), (9002, "", "en", "a", 0), (9003, None, "en", "a", 0)]


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_components_are_those_of_all_pairs(make_docs, radius):
    rows = near_texts()
    found = {r["doc_id"]: r for r in simhash.near_duplicates(make_docs(rows), radius).collect()}
    assert len(found) == len(rows)
    fps = [naive(r[1]) for r in rows]
    for r, fp, first in zip(rows, fps, groups(fps, radius), strict=True):
        assert found[r[0]]["fingerprint"] == f"{fp:016x}" and found[r[0]]["component_id"] == rows[first][0]


def crowd(n: int, seed: int) -> list[int]:
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    out = set()
    while len(out) < n:
        fp = int(centre[rng.integers(12)])
        for bit in rng.integers(0, 64, rng.integers(0, 9)):
            fp ^= 1 << int(bit)
        out.add(fp)
    return sorted(out)


@pytest.mark.parametrize(("split", "tile"), [(16384, 512), (40, 512), (7, 512), (40, 16), (7, 5)])
def test_links_of_crowded_keys(spark, monkeypatch, split, tile):
    """Salted parts and tiles lose no link."""
    monkeypatch.setattr(simhash, "TILE", tile)
    fps = crowd(500, 5)
    signed = [fp - (1 << 64) if fp >> 63 else fp for fp in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, split)
    if tile == 512:  # executors import the module anew
        pairs = [(r["u"], r["v"]) for r in links.collect()]
    else:
        tiles = simhash._tiles(np.array(fps, np.uint64), None, 3)
        pairs = [x for us, vs in tiles for x in zip(us.view(np.int64).tolist(), vs.view(np.int64).tolist(), strict=True)]
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in pairs:  # ends of a forest's link can be farther apart than the radius, but are connected
        parent[find(u)] = find(v)
    label = groups(fps, 3)
    assert len({find(x) for x in signed}) == len(set(label))
    assert all(find(x) == find(signed[k]) for x, k in zip(signed, label, strict=True))


def test_tile_pairs_emit_no_more_than_a_forest():
    fps = np.array([1 << k for k in range(60)], np.uint64)  # all within two bits of each other
    u, v = simhash._forest(fps, None, 3)
    assert len(u) == len(v) == 59


def test_distant_tiles_are_skipped(monkeypatch):
    compared = []
    whole = simhash._forest
    monkeypatch.setattr(simhash, "TILE", 4)
    monkeypatch.setattr(simhash, "_forest", lambda a, b, radius: compared.append(1) or whole(a, b, radius))
    fps = np.array([(1 << (2 * k)) - 1 for k in range(32)], np.uint64)  # population counts 0, 2, 4, ...
    found = {x for u, v in simhash._tiles(fps, None, 3) for x in zip(u.tolist(), v.tolist(), strict=True)}
    assert len(compared) == 15 < 36 and len(found) == 31


def test_finer_keys_hold_the_other_bits(spark):
    fps = crowd(40, 3)
    signed = [fp - (1 << 64) if fp >> 63 else fp for fp in fps]
    rows = spark.createDataFrame([(x,) for x in signed], "fp long").select("fp", simhash.F.explode(simhash._keys(simhash.F.col("fp"))).alias("key"))
    for r in rows.select("fp", "key", simhash._finer(simhash.F.col("fp"), simhash.F.col("key")).alias("finer")).collect():
        n, fp = r["key"] >> 32, r["fp"] % (1 << 64)
        rest = fp & ((1 << 16 * n) - 1) | fp >> 16 * (n + 1) << 16 * n
        assert r["key"] & 0xFFFF == fp >> 16 * n & 0xFFFF
        assert [x & 0xFFF for x in r["finer"]] == [rest >> 12 * m & 0xFFF for m in range(4)] and len(set(r["finer"])) == 4


@pytest.mark.parametrize("hot", [3, 100_000])
def test_connected_components(spark, hot):
    chain = [(k, k + 1) for k in range(200)] + [(1000 + k, 1000) for k in range(50)] + [(5, 5), (7, 8), (8, 7)]
    found = connected_components(spark.createDataFrame(chain, "u long, v long"), Scratch(spark, "test"), hot)
    roots = {r["node"]: r["root"] for r in found.collect()}
    assert roots == {**{k: 0 for k in range(201)}, **{1000 + k: 1000 for k in range(51) if k < 50}}


@pytest.mark.parametrize(("hot", "local"), [(3, 0), (100_000, 0), (3, 60), (100_000, 1 << 18)])
def test_connected_components_in_one_task_or_many(spark, hot, local):
    """A limit of 0 leaves all to contraction, one of 60 is met between the rounds."""
    rng = np.random.default_rng(8)
    links = [(int(u) - 150, int(v) - 150) for u, v in rng.integers(0, 300, (160, 2))] + [(1000 + k, 1001 + k) for k in range(100)] + [(2000 - k, 2000) for k in range(70)]
    first = {x: x for link in links for x in link if link[0] != link[1]}
    while any(first[u] != first[v] for u, v in links if u != v):
        for u, v in links:
            if u != v:
                first[u] = first[v] = min(first[u], first[v])
    found = connected_components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "test"), hot, local).collect()
    assert len(found) == len(first) and {r["node"]: r["root"] for r in found} == first
    assert connected_components(spark.createDataFrame([(5, 5)], "u long, v long"), Scratch(spark, "test"), hot, local).count() == 0


def test_edges(edges):
    found = simhash.near_duplicates(edges).collect()
    assert len(found) == len(edge_rows())
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by_id[2]["fingerprint"] == by_id[3]["fingerprint"] == by_id[8]["fingerprint"] == "0" * 16
    assert by_id[3]["component_id"] == by_id[8]["component_id"] == 2
    assert by_id[7]["component_id"] == by_id[10]["component_id"] == 1
    assert {r["component_id"] for r in found if r["doc_id"] is None and r["fingerprint"] == "0" * 16} == {2}


def test_one_of_each(edges, make_docs):
    kept = simhash.one_of_each(edges)
    assert kept.columns == edges.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and 2 in ids and not {3, 7, 8, 10} & set(ids) and len(ids) == len(set(ids))
    rows = near_texts()
    fps = [naive(r[1]) for r in rows]
    wanted = {rows[k][0] for k in set(groups(fps, 3))}
    assert {r["doc_id"] for r in simhash.one_of_each(make_docs(rows, clashing=True)).collect()} == wanted


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0


def test_larger_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), 4)
