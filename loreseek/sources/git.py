"""A git history as a Spark data source, in batch and as a stream.

Options: path (a repository, readable by the executors), ref (default HEAD),
since (a commit whose history is left out), kind ("commits", "blobs" or
"refs"), maxCommits (of a micro-batch).

Commits are dealt to partitions by their place in the walk: a task lists the
hashes of its ``PART`` places and lets git compare those commits with their
parents, so no process holds a history. The list of files is one walk of the
object graph, passed on line by line; contents are read where they are needed,
by partition, with ``read_blobs``.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from loreseek.schemas import BLOBS, COMMITS

KINDS = {"commits": COMMITS, "blobs": BLOBS, "refs": "ref string, hash string"}
PART = 5_000  # commits of a task
_FIELDS = "%H%x00%ct%x00%an%x00%ae%x00%s"


def _git(path: str, *args: str, data: bytes | None = None) -> bytes | None:
    """The output of git, or None if it fails; for short outputs."""
    done = subprocess.run(["git", "-C", path, *args], input=data, capture_output=True)
    return done.stdout if done.returncode == 0 else None


def _records(path: str, *args: str, data: bytes = b"", end: bytes = b"\n") -> Iterator[bytes]:
    """The output of git, record by record as it comes. Its input must be short, or of a command that reads all of it first."""
    with subprocess.Popen(["git", "-C", path, *args], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
        try:
            run.stdin.write(data)
            run.stdin.close()
            rest = b""
            while chunk := run.stdout.read1(1 << 16):
                *whole, rest = (rest + chunk).split(end)
                yield from whole
            if rest:
                yield rest
            if run.wait():
                raise RuntimeError(f"git {args[0]} failed in {path}")
        finally:
            run.kill()


def resolve_ref(path: str, ref: str) -> str | None:
    """The commit that a ref names, or None."""
    out = _git(path, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{ref}^{{commit}}")
    return out.decode().strip() if out else None


def _range(path: str, ref: str, since: str | None) -> list[str] | None:
    """The walk's arguments; an unknown ``since`` leaves nothing out, an unknown ref has no walk."""
    tip = resolve_ref(path, ref)
    start = resolve_ref(path, since) if since else None
    return None if tip is None else [tip, *([f"^{start}"] if start else [])]


def _count(path: str, walk: list[str]) -> int:
    return int(_git(path, "rev-list", "--count", *walk) or 0)


def _hashes(path: str, walk: list[str], skip: int, most: int) -> list[str]:
    """The commits at some places of a walk, newest first."""
    return [h.decode() for h in _records(path, "rev-list", f"--skip={skip}", f"--max-count={most}", *walk)]


def details(path: str, hashes: list[str]) -> Iterator[tuple]:
    """Rows of the named commits, in their order. Changes are those against the first parent (a root's: all files); deletions and submodules are left out, renames are additions."""
    for at in range(0, len(hashes), PART):
        names = "\n".join(hashes[at : at + PART]).encode() + b"\n"
        told = _records(path, "log", "--stdin", "--no-walk=unsorted", "--diff-merges=first-parent", "--raw", "-z", "--no-renames", "--root", "--no-abbrev", "-r", f"--format={_FIELDS}", data=names, end=b"\0")
        row: tuple | None = None
        for token in told:
            if token.startswith((b"\n:", b":")):
                meta, name = token.strip(b"\n").decode().split(" "), next(told)
                if meta[4][0] in "AMCT" and meta[1] != "160000":
                    row[5].append((name.decode("utf-8", "replace"), meta[3]))
            elif token:
                if row:
                    yield row
                commit, ts, author, email, subject = (x.decode("utf-8", "replace") for x in (token, *islice(told, 4)))
                row = commit, int(ts), author, email, subject, []
        if row:
            yield row


def commits(path: str, ref: str = "HEAD", since: str | None = None) -> Iterator[tuple]:
    """The commits of a range, newest first, as one process reads them."""
    walk = _range(path, ref, since)
    for skip in range(0, _count(path, walk) if walk else 0, PART):
        yield from details(path, _hashes(path, walk, skip, PART))


def blobs(path: str, ref: str = "HEAD", since: str | None = None) -> Iterator[tuple[str, str, int]]:
    """(path, blob, place in the walk): each file content once, under the first path that reaches it."""
    walk = _range(path, ref, since)
    found = _records(path, "rev-list", "--objects", "--filter=object:type=blob", "--filter-provided-objects", *walk) if walk else ()
    for n, line in enumerate(found):
        blob, _, name = line.decode("utf-8", "replace").partition(" ")
        if name:
            yield name, blob, n


def read_blobs(path: str, hashes: list[str], max_bytes: int | None = None) -> list[bytes | None]:
    """Contents, in order; None for a missing blob or one of more than ``max_bytes`` bytes, whose content is not read."""
    sizes = (_git(path, "cat-file", "--batch-check=%(objectname) %(objecttype) %(objectsize)", data="\n".join(hashes).encode() + b"\n") or b"").decode().splitlines() if hashes else []
    fit = [h for h, line in zip(hashes, sizes, strict=True) if " blob " in line and (max_bytes is None or int(line.rsplit(" ", 1)[1]) <= max_bytes)]
    found: dict[str, bytes] = {}
    data, at = (_git(path, "cat-file", "--batch", data="\n".join(fit).encode() + b"\n") or b"") if fit else b"", 0
    for h in fit:
        end = data.index(b"\n", at)
        size = int(data[at:end].rsplit(b" ", 1)[1])
        found[h] = data[end + 1 : end + 1 + size]
        at = end + 2 + size
    return [found.get(h) for h in hashes]


def with_content(entries: DataFrame, path: str, max_bytes: int | None = None) -> DataFrame:
    """``entries`` (.., blob_hash, ..) with content (malformed UTF-8 replaced, null if too large); the repository must be readable by executors."""
    place = entries.columns.index("blob_hash")
    from pyspark.sql import types as T

    schema = T.StructType([*entries.schema.fields, T.StructField("content", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [None if b is None else b.decode("utf-8", "replace") for b in read_blobs(path, batch.column(place).to_pylist(), max_bytes)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "content"])

    return entries.mapInArrow(run, schema)


class _Places(InputPartition):
    """Places of a walk, from ``skip`` on."""

    def __init__(self, walk: list[str], skip: int) -> None:
        super().__init__(skip)
        self.walk, self.skip = walk, skip


def _dealt(path: str, walk: list[str] | None) -> list[InputPartition]:
    return [_Places(walk, skip) for skip in range(0, _count(path, walk), PART)] if walk else []


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.kind, self.path = options.get("kind", "commits"), options["path"]

    def partitions(self) -> list[InputPartition]:
        ref, since = self.options.get("ref", "HEAD"), self.options.get("since") or None
        if self.kind == "commits":
            # The walk is named by hashes here, so all tasks see one history even if the ref moves.
            return _dealt(self.path, _range(self.path, ref, since)) or [_Places([], 0)]
        return [_Places(_range(self.path, ref, since) or [], 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.kind == "refs":
            for line in _records(self.path, "for-each-ref", "--format=%(refname)%00%(objectname)"):
                yield tuple(line.decode("utf-8", "replace").split("\0"))
        elif not partition.walk:
            return
        elif self.kind == "commits":
            yield from details(self.path, _hashes(self.path, partition.walk, partition.skip, PART))
        else:
            yield from blobs(self.path, partition.walk[0], partition.walk[1][1:] if len(partition.walk) > 1 else None)


def _heads(path: str, offset: dict) -> list[str]:
    """The commits that an offset names and that still exist: what they reach was read."""
    return [h for h in offset["heads"].split() if resolve_ref(path, h)]


def _offset(heads) -> dict:
    return {"heads": " ".join(sorted(heads))}


def _between(path: str, start: dict, end: dict) -> list[str] | None:
    tips = _heads(path, end)
    return [*tips, *(f"^{h}" for h in _heads(path, start))] if tips else None


class GitStream(DataSourceStreamReader):
    """All commits since the offset's heads, dealt to tasks. A ref that was moved back and forth again may give commits twice."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.ref, self.since = options["path"], options.get("ref", "HEAD"), options.get("since") or None

    def initialOffset(self) -> dict:
        start = resolve_ref(self.path, self.since) if self.since else None
        return _offset([start] if start else [])

    def latestOffset(self) -> dict:
        tip = resolve_ref(self.path, self.ref)
        return _offset([tip]) if tip else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _dealt(self.path, _between(self.path, start, end)) or [_Places([], 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return details(self.path, _hashes(self.path, partition.walk, partition.skip, PART)) if partition.walk else iter(())


class GitBatches(SimpleDataSourceStreamReader):
    """At most maxCommits commits a micro-batch, parents before children.

    The offset names the heads of all that was read. What was read is closed under parents, so the next
    batch is the oldest part, in topological order, of what the ref reaches and the heads don't.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.ref, self.most = options["path"], options.get("ref", "HEAD"), max(1, int(options["maxcommits"]))
        self.start = GitStream(options)

    def initialOffset(self) -> dict:
        return self.start.initialOffset()

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        tip, heads = resolve_ref(self.path, self.ref), _heads(self.path, start)
        if tip is None:
            return iter(()), start
        lines = _records(self.path, "rev-list", "--topo-order", "--reverse", "--parents", tip, *(f"^{h}" for h in heads))
        taken = [line.decode().split() for line in islice(lines, self.most)]
        lines.close()
        if not taken:
            return iter(()), start
        parents = {p for _, *ps in taken for p in ps}
        rows = list(details(self.path, [c for c, *_ in reversed(taken)]))  # Spark copies this iterator, so it is that of a list
        return iter(rows), _offset({*heads, *(c for c, *_ in taken)} - parents)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        walk = _between(self.path, start, end)
        return details(self.path, _hashes(self.path, walk, 0, self.most)) if walk else iter(())


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "githistory"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "commits")]

    def reader(self, schema) -> DataSourceReader:
        return GitReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        if "maxcommits" in self.options:
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "streamReader with maxCommits"})  # Spark then asks for the simple reader
        return GitStream(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return GitBatches(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)


def stream_commits(spark: SparkSession, path: str, ref: str = "HEAD", since: str | None = None) -> DataFrame:
    """The commit scan: one row a commit."""
    register(spark)
    return spark.read.format("githistory").options(kind="commits", path=path, ref=ref, since=since or "").load()


def stream_blobs(spark: SparkSession, path: str, ref: str = "HEAD", since: str | None = None) -> DataFrame:
    """The file scan: one row a content."""
    register(spark)
    return spark.read.format("githistory").options(kind="blobs", path=path, ref=ref, since=since or "").load()
