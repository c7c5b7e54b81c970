"""The git source against real repositories, in batch and as a stream."""

from __future__ import annotations

import random
import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loreseek.sources import git


class Repo:
    def __init__(self, path: Path) -> None:
        self.path = path
        path.mkdir(exist_ok=True)
        self.run("init", "-q", "-b", "main")
        self.n = 0

    def run(self, *args: str) -> str:
        env = {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "ann@example.org", "GIT_COMMITTER_NAME": "Cy", "GIT_COMMITTER_EMAIL": "cy@example.org", "PATH": "/usr/bin:/bin", "HOME": str(self.path), "GIT_CONFIG_NOSYSTEM": "1"}
        if args[0] in ("commit", "merge"):
            self.n += 1
            env |= {"GIT_AUTHOR_DATE": f"@{500 + self.n} +0000", "GIT_COMMITTER_DATE": f"@{1000 + self.n} +0000"}
        return subprocess.run(["git", "-C", str(self.path), *args], check=True, capture_output=True, text=True, env=env).stdout.strip()

    def commit(self, message: str, files: dict[str, str | bytes | None]) -> str:
        for name, content in files.items():
            at = self.path / name
            at.parent.mkdir(parents=True, exist_ok=True)
            if content is None:
                self.run("rm", "-q", name)
            else:
                at.write_bytes(content if isinstance(content, bytes) else content.encode())
                self.run("add", name)
        self.run("commit", "-q", "--allow-empty", "-m", message)
        return self.run("rev-parse", "HEAD")


@pytest.fixture
def repo(tmp_path) -> Repo:
    return Repo(tmp_path / "repo")


def test_commits_newest_first_with_their_changes(spark, repo):
    c1 = repo.commit("first line\n\nbody", {"a.txt": "one", "d/b ü.txt": "two"})
    c2 = repo.commit("second", {"a.txt": "changed", "c.txt": "one"})
    c3 = repo.commit("third", {"d/b ü.txt": None})
    repo.run("mv", "c.txt", "moved.txt")
    c4 = repo.commit("fourth", {})
    rows = git.stream_commits(spark, str(repo.path)).collect()
    assert [r["hash"] for r in rows] == [c4, c3, c2, c1]
    assert [r["message"] for r in rows] == ["fourth", "third", "second", "first line"]
    assert (rows[3]["timestamp"], rows[3]["author_name"], rows[3]["author_email"]) == (1001, "Ann", "ann@example.org")
    changed = [sorted(x["path"] for x in r["changed_blobs"]) for r in rows]
    assert changed == [["moved.txt"], [], ["a.txt", "c.txt"], ["a.txt", "d/b ü.txt"]]
    assert rows[0]["changed_blobs"][0]["blob_hash"] == repo.run("hash-object", str(repo.path / "moved.txt"))


def test_merges_are_compared_with_their_first_parent(spark, repo):
    repo.commit("base", {"a": "1"})
    repo.run("checkout", "-q", "-b", "side")
    side = repo.commit("side", {"s": "side"})
    repo.run("checkout", "-q", "main")
    repo.commit("main", {"m": "main"})
    repo.run("merge", "-q", "--no-ff", "-m", "merge", "side")
    rows = {r["message"]: r for r in git.stream_commits(spark, str(repo.path)).collect()}
    assert rows["side"]["hash"] == side and [x["path"] for x in rows["merge"]["changed_blobs"]] == ["s"]


def test_range_and_unknown_names(spark, repo):
    c1 = repo.commit("1", {"a": "1"})
    c2 = repo.commit("2", {"b": "2"})
    path = str(repo.path)
    assert [r["hash"] for r in git.stream_commits(spark, path, "HEAD", c1).collect()] == [c2]
    assert git.stream_commits(spark, path, "HEAD", c2).count() == 0
    assert git.stream_commits(spark, path, "absent").count() == 0 and git.stream_blobs(spark, path, "absent").count() == 0
    assert git.stream_commits(spark, path, "HEAD", "0" * 40).count() == 2
    assert git.resolve_ref(path, "main") == c2 and git.resolve_ref(path, "absent") is None and git.resolve_ref(path, "--all") is None


def test_each_content_once_under_one_path(spark, repo):
    c1 = repo.commit("1", {"a.txt": "same", "b.txt": "same", "c.txt": "other"})
    rows = git.stream_blobs(spark, str(repo.path)).collect()
    assert len(rows) == 2 and {r["path"] for r in rows} <= {"a.txt", "b.txt", "c.txt"}
    repo.commit("2", {"c.txt": "new"})
    assert [r["path"] for r in git.stream_blobs(spark, str(repo.path), "HEAD", c1).collect()] == ["c.txt"]


def test_contents(spark, repo):
    repo.commit("1", {"big": "x" * 101, "fits": "x" * 100, "bytes": b"\xff\xfea", "empty": ""})
    path = str(repo.path)
    found = {r["path"]: r["content"] for r in git.with_content(git.stream_blobs(spark, path), path, 100).collect()}
    assert found == {"big": None, "fits": "x" * 100, "bytes": "��a", "empty": ""}
    assert git.read_blobs(path, ["0" * 40, repo.run("rev-parse", "HEAD:fits"), repo.run("rev-parse", "HEAD:")]) == [None, b"x" * 100, None]


def test_refs(spark, repo):
    c1 = repo.commit("1", {"a": "1"})
    git.register(spark)
    rows = spark.read.format("githistory").options(kind="refs", path=str(repo.path)).load().collect()
    assert [(r["ref"], r["hash"]) for r in rows] == [("refs/heads/main", c1)]


def test_stream_resumes_from_its_checkpoint(spark, repo, tmp_path):
    from loreseek.streaming.follow import commit_stream

    seen: list[list[str]] = []

    def take(batch, number):
        seen.append([r["message"] for r in batch.collect()])

    def run():
        query = commit_stream(spark, str(repo.path)).writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/checkpoint").start()
        query.processAllAvailable()
        query.stop()

    repo.commit("1", {"a": "1"})
    repo.commit("2", {"b": "1"})
    run()
    assert sum(seen, []) == ["2", "1"]
    seen.clear()
    repo.commit("3", {"c": "1"})
    run()
    assert sum(seen, []) == ["3"]


def test_changes_explode(spark, repo):
    repo.commit("1", {"a": "1", "b": "2"})
    rows = git.stream_commits(spark, str(repo.path)).select(F.explode("changed_blobs").alias("c")).select("c.path", "c.blob_hash")
    assert rows.count() == 2


def random_history(repo, seed: int, many: int = 14) -> list[str]:
    """Commits on several branches with merges, made without a work tree."""
    rng = random.Random(seed)
    tree = repo.run("mktree")
    made: list[str] = []
    for k in range(many):
        parents = rng.sample(made[-5:], min(len(made), rng.choice([1, 1, 1, 2, 3]))) if made else []
        made.append(repo.run("commit-tree", tree, "-m", f"c{k}", *(x for p in parents for x in ("-p", p))))
    heads = [c for c in made if all(c not in repo.run("rev-list", d).split()[1:] for d in made)]
    last = heads[0] if len(heads) == 1 else repo.run("commit-tree", tree, "-m", "all", *(x for h in heads for x in ("-p", h)))
    repo.run("update-ref", "refs/heads/main", last)
    return repo.run("rev-list", last).split()


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("most", [1, 2, 3, 5, 100])
def test_batches_give_each_commit_of_merges_once(repo, seed, most):
    wanted = random_history(repo, seed)
    reader = git.GitBatches({"path": str(repo.path), "maxcommits": str(most)})
    at, found = reader.initialOffset(), []
    for _ in range(len(wanted) + 1):
        rows, after = reader.read(at)
        batch = [r[0] for r in rows]
        assert len(batch) <= most and sorted(batch) == sorted(r[0] for r in reader.readBetweenOffsets(at, after))
        if after == at:
            break
        found, at = found + batch, after
    assert sorted(found) == sorted(wanted) and at == {"heads": wanted[0]}
    assert git.GitStream({"path": str(repo.path)}).latestOffset() == at
    # A resumed reader takes what came after.
    tree = repo.run("mktree")
    repo.run("update-ref", "refs/heads/main", repo.run("commit-tree", tree, "-m", "new", "-p", wanted[0]))
    rows, _ = git.GitBatches({"path": str(repo.path), "maxcommits": str(most)}).read(at)
    assert [r[4] for r in rows] == ["new"]


def test_walks_are_dealt_to_tasks(spark, repo, monkeypatch):
    for k in range(7):
        repo.commit(f"{k}", {"f": f"{k}"})
    monkeypatch.setattr(git, "PART", 3)
    reader = git.GitReader({"path": str(repo.path)})
    parts = [[r[4] for r in reader.read(p)] for p in reader.partitions()]
    assert parts == [["6", "5", "4"], ["3", "2", "1"], ["0"]]
    assert [r[4] for r in git.commits(str(repo.path))] == sum(parts, [])


def test_odd_subjects(spark, repo):
    repo.commit("a\x1eb\x1fc :", {"a": "1"})
    repo.run("commit", "-q", "--allow-empty", "--allow-empty-message", "-m", "")
    rows = git.stream_commits(spark, str(repo.path)).collect()
    assert [r["message"] for r in rows] == ["", "a\x1eb\x1fc :"] and [len(r["changed_blobs"]) for r in rows] == [0, 1]


def test_stream_with_batches_ends_at_the_tip(spark, repo, tmp_path):
    from loreseek.streaming.follow import commit_stream

    wanted, seen = random_history(repo, 3, 6), []
    query = commit_stream(spark, str(repo.path), max_commits=2).writeStream.foreachBatch(lambda b, n: seen.extend(r["hash"] for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == sorted(wanted)
