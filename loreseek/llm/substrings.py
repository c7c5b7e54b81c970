"""Exact removal of repeated 100-byte strings by blockwise sorting of suffix buckets.

A byte is removed if a ``WIDTH``-byte string that covers it also starts
earlier: in a document of smaller id, or earlier in the same one.

The cover sample. A difference cover picks sample positions so that two equal
windows always share a sample at one common shift. Here the cover is chosen by
content (each window samples its least hashed ``GRAM``-gram, leftmost on ties),
which keeps that property and samples about 3 % of the positions where a cover
periodic modulo 64 samples 14 %. A sample's rank is the name (hash) of its
gram; the windows that share one sample make a record: the gram's name, the
name of their common text, the document, the first window and their number.

Blockwise order. Records are dealt into suffix buckets by the gram's name and
each bucket is sorted by (name, text name, document, place) and streamed once,
so memory doesn't follow a bucket's size. Equal text names are long ties: all
windows of all but the first record are repeats. Where one gram stands in
different surroundings, the first record of each text sends its text to its
bucket, and the buckets are sorted block by block: the samples' right texts and
(backwards) left texts are ranked once, with the lengths of common prefixes,
and a window that starts r bytes before its sample is told from the others by
two ranks, that of its r left bytes and that of its WIDTH - r right bytes,
instead of by comparing bytes again.

Hot groups. Records of one task are combined before the shuffle, so a passage
held by a third of all documents costs one record a task and not one a
document; what the combination settles is dealt by document. A bucket of more
than ``BLOCK`` different texts isn't sorted in one task: its windows are dealt
singly, by 128-bit names, with the same combination.

Equality rests on 64-bit text names within one gram's bucket, on bytes within
sorted blocks, and on 128-bit window names in hot buckets.

Defined results: null and empty texts have no bytes and the hash of no bytes;
texts under ``WIDTH`` bytes stay whole; documents with a null id come last;
rows that share an id but not the text are ordered by a hash of the text;
fully repeated rows are one document and each gets its result; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreseek.llm.common import pieces, text_bytes
from loreseek.operators.walk import count_windows
from loreseek.sources.shared import Scratch

WIDTH = 100
GRAM = 32
SEGMENT = 1 << 20  # bytes that are hashed at once; temporaries take dozens of times that
HELD = 1 << 20  # records of a task that are combined at once
BLOCK = 32768  # texts that are sorted at once
SLICE = 2048  # texts whose bytes are gathered at once

_RECORD = "h long, c long, doc long, at long"
#: ``at`` is the first window << 16, the sample's distance from it << 8, and the number of windows.
_FOLLOWS = 128  # in ``at``: settled already

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _grams(flat: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of each gram."""
    power, inverse = _power(len(flat))
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_TABLE[flat] * power, out=total[1:])
    x = (total[gram:] - total[:-gram]) * inverse[: len(flat) - gram + 1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def cover(flat: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The records of texts laid end to end: document index, first window, number of windows, the sample's distance from the first, gram's name.

    A text beyond ``SEGMENT`` is cut into overlapping parts; a cut only makes a record into two.
    """
    found = []
    for begin, docs in _segments(offsets, width):
        end = min(int(docs[-1][2]), len(flat))
        part = flat[begin:end]
        if len(part) < width:
            continue
        names = _grams(part, gram)
        key = (names >> np.uint64(24) << np.uint64(24)) | np.arange(len(names), dtype=np.uint64)
        place = (_least(key, width - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        edge = np.zeros(len(part) + 1, np.int32)
        d = np.array([x for x in docs if x[2] - x[1] >= width], np.int64).reshape(-1, 3)
        np.add.at(edge, d[:, 1] - begin, 1)
        np.add.at(edge, d[:, 2] - width + 1 - begin, -1)
        windows = np.flatnonzero(np.cumsum(edge[: len(place)]) > 0)
        if not len(windows):
            continue
        at = place[windows]
        cut = np.flatnonzero((at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)) + 1
        first, last = windows[np.r_[0, cut]], windows[np.r_[cut, len(windows)] - 1]
        own = d[np.searchsorted(d[:, 1], first + begin, side="right") - 1, 0]
        sample = at[np.r_[0, cut]]
        found.append((own, first + begin, last - first + 1, sample - first, names[sample].view(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _segments(offsets: np.ndarray, width: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(begin, [(document, its part's begin, its part's end)]) of at most about SEGMENT bytes each."""
    begin, docs = 0, []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if docs and b - begin > SEGMENT:
            yield begin, docs
            docs = []
        if not docs:
            begin = a
        while b - a > SEGMENT:
            yield a, [(k, a, a + SEGMENT)]
            a = begin = a + SEGMENT - width + 1
        docs.append((k, a, b))
    if docs:
        yield begin, docs


def _named(flat: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    data, digest = flat.tobytes(), xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]), ">i8").astype(np.int64)


def _batch(h, c, doc, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, doc, at)], names=["h", "c", "doc", "at"])


def _combined(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """One record for each (h, c), the earliest; the others are settled and dealt by document. Empties ``parts``, so that records are held once."""
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    parts.clear()
    order = np.lexsort(columns[::-1])
    for k in range(len(columns)):
        columns[k] = columns[k][order]
    h, c, doc, at = columns
    del columns, order
    follows = np.zeros(len(h), bool)
    follows[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    at = np.where(follows, at | _FOLLOWS, at)
    h = np.where(follows, (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), h)
    for k in range(0, len(h), 1 << 16):
        yield _batch(h[k : k + (1 << 16)], c[k : k + (1 << 16)], doc[k : k + (1 << 16)], at[k : k + (1 << 16)])


def _collected(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    held, many = [], 0
    for part in parts:
        held.append(part)
        many += len(part[0])
        del part
        if many >= HELD:
            yield from _combined(held)
            many = 0
    if many:
        yield from _combined(held)


def _records(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    def each():
        for batch in pieces(batches, SEGMENT):
            flat, offsets = text_bytes(batch.column(1))
            own, first, many, away, names = cover(flat, offsets, width, gram)
            if len(own):
                keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield names, _named(flat, first, first + many - 1 + width), keys[own], ((first - offsets[own]) << 16) | (away << 8) | many

    yield from _collected(each())


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The single windows of the marked records, under 128-bit names."""

    def each():
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            keys, texts, marks = (batch.column(k) for k in range(3))
            for k in np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False)).tolist():
                data = texts[k].as_py().encode()
                starts = [s for x in marks[k].as_py() if x["hot"] for s in range(x["at"] >> 16, (x["at"] >> 16) + (x["at"] & 127))]
                if starts:
                    names = np.frombuffer(b"".join([digest(data[s : s + width]) for s in starts]), ">i8").astype(np.int64).reshape(-1, 2)
                    yield names[:, 0].copy(), names[:, 1].copy(), np.full(len(starts), keys[k].as_py(), np.int64), (np.array(starts, np.int64) << 16) | 1

    yield from _collected(each())


def _texts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(h, doc, at, text) of the marked records: the bytes that their windows cover."""
    for batch in pieces(batches, 16 << 20):
        flat, offsets = text_bytes(batch.column(1))
        data, marks = flat.tobytes(), batch.column(2)
        rows: list[tuple] = []
        for k in np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False)).tolist():
            doc, begin = batch.column(0)[k].as_py(), int(offsets[k])
            for x in marks[k].as_py():
                if not x["hot"]:
                    a = begin + (x["at"] >> 16)
                    rows.append((x["h"], doc, x["at"], data[a : a + (x["at"] & 127) - 1 + width]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["h", "doc", "at", "text"])


def _ranked(bucket: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of texts (uint8, one a row) within their buckets, and how many bytes each shares with the one before (-1: another bucket)."""
    padded = np.zeros((len(texts), -(-texts.shape[1] // 8) * 8), np.uint8)
    padded[:, : texts.shape[1]] = texts
    order = np.lexsort([*padded.view(">u8").astype(np.uint64).T[::-1], bucket])
    differ = texts[order[1:]] != texts[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), texts.shape[1])
    return order, np.r_[-1, np.where(bucket[order[1:]] == bucket[order[:-1]], common, -1)]


def repeated_windows(bucket: np.ndarray, away: np.ndarray, many: np.ndarray, texts: list[bytes], width: int, gram: int) -> np.ndarray:
    """For each text and distance r of a window's start before the sample: whether an earlier text of the bucket has this window.

    Texts come in the order of documents; each begins ``away`` bytes before its sample and has ``many`` windows.
    """
    reach = width - gram
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum([0, *map(len, texts)])[:-1]
    size = many - 1 + width
    right, left = np.empty((len(texts), width), np.uint8), np.empty((len(texts), reach), np.uint8)
    for k in range(0, len(texts), SLICE):  # places take eight times the bytes
        rows = slice(k, k + SLICE)
        place = away[rows, None] + np.arange(width)  # from the sample on
        right[rows] = np.where(place < size[rows, None], flat[np.minimum(begin[rows, None] + place, len(flat) - 1)], 0)
        place = away[rows, None] - 1 - np.arange(reach)  # backwards from the sample
        left[rows] = np.where(place >= 0, flat[np.maximum(begin[rows, None] + place, 0)], 0)
    (right_order, right_common), (left_order, left_common) = _ranked(bucket, right), _ranked(bucket, left)
    out = np.zeros((len(texts), reach + 1), bool)
    left_rank, right_rank = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
    for r in range(reach + 1):
        own = np.flatnonzero((away >= r) & (away - many < r))
        if len(own) < 2:
            continue
        left_rank[left_order] = np.cumsum(left_common < r)
        right_rank[right_order] = np.cumsum(right_common < width - r)
        pair = left_rank[own] * (len(texts) + 1) + right_rank[own]
        order = np.argsort(pair, kind="stable")
        again = order[1:][pair[order[1:]] == pair[order[:-1]]]
        out[own[again], r] = True
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(doc, at) of the repeated windows of rows (h, doc, at, text) sorted by h, whole buckets at a time."""
    held: list[pa.RecordBatch] = []

    def close(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h, doc, at = (table.column(k).to_numpy() for k in range(3))
        order = np.lexsort((at, doc))
        texts = table.column(3).to_pylist()
        h, doc, at, texts = h[order], doc[order], at[order], [texts[k] for k in order.tolist()]
        bucket = np.unique(h, return_inverse=True)[1]
        first, away, many = at >> 16, at >> 8 & 127, at & 127
        again = repeated_windows(bucket, away, many, texts, width, gram)[:, ::-1]  # now by rising start
        edge = np.diff(again.astype(np.int8), axis=1, prepend=0, append=0)
        rows, begin = np.nonzero(edge > 0)
        end = np.nonzero(edge < 0)[1]
        start = first[rows] + away[rows] - (width - gram) + begin
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(start << 16 | end - begin)], names=["doc", "at"])

    many = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            many += batch.num_rows
        if many >= BLOCK:
            table = pa.Table.from_batches(held)
            h = table.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield from close(table.slice(0, cut))
            held, many = table.slice(cut).to_batches(), table.num_rows - cut
    if many:
        yield from close(pa.Table.from_batches(held))


def _settled(batches: Iterator[pa.RecordBatch], single: bool) -> Iterator[pa.RecordBatch]:
    """(doc, at, open, h) of sorted records: repeats with open false; where a name has several texts, their first records with open true."""
    last = None  # the row before: h, c
    first = None  # the first record of the present name while it has one text only: h, doc, at
    for batch in batches:
        if not batch.num_rows:
            continue
        h, c, doc, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        follows = (at & _FOLLOWS) > 0
        out = [(doc[follows], at[follows] & ~_FOLLOWS, np.zeros(int(follows.sum()), bool), np.zeros(int(follows.sum()), np.int64))]
        h, c, doc, at = h[~follows], c[~follows], doc[~follows], at[~follows]
        if len(h):
            same_h, same = np.zeros(len(h), bool), np.zeros(len(h), bool)
            same_h[1:] = h[1:] == h[:-1]
            same[1:] = same_h[1:] & (c[1:] == c[:-1])
            if last:
                same_h[0] = h[0] == last[0]
                same[0] = same_h[0] and c[0] == last[1]
            out.append((doc[same], at[same], np.zeros(int(same.sum()), bool), np.zeros(int(same.sum()), np.int64)))
            last = int(h[-1]), int(c[-1])
            if not single:
                rows = np.flatnonzero(~same)
                hs, ds, ats, joined = h[rows], doc[rows], at[rows], same_h[rows].copy()
                if first is not None:
                    hs, ds, ats = np.r_[first[0], hs], np.r_[first[1], ds], np.r_[first[2], ats]
                    joined = np.r_[False, joined]
                if len(hs):
                    several = joined.copy()
                    several[:-1] |= joined[1:]
                    keep = len(hs) - 1 if not joined[-1] and int(hs[-1]) == last[0] else len(hs)
                    out.append((ds[:keep][several[:keep]], ats[:keep][several[:keep]], np.ones(int(several[:keep].sum()), bool), hs[:keep][several[:keep]]))
                    first = (int(hs[-1]), int(ds[-1]), int(ats[-1])) if keep < len(hs) else None
        docs, ats, opened, names = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(docs):
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(ats), pa.array(opened), pa.array(names)], names=["doc", "at", "open", "h"])


def _sorted(records: DataFrame, single: bool) -> DataFrame:
    keys = ["h", "c", "doc", "at"]
    return records.repartition("h", *(["c"] if single else [])).sortWithinPartitions(*keys).mapInArrow(lambda b: _settled(b, single), "doc long, at long, open boolean, h long")


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 16 << 20):
        flat, offsets = text_bytes(batch.column(1))
        marks = batch.column(2)
        rows = []
        for k in range(batch.num_rows):
            data = flat[offsets[k] : offsets[k + 1]]
            removed = spans = 0
            if marks[k].is_valid:
                at = np.asarray(marks[k].values)
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, at >> 16, 1)
                np.add.at(edge, (at >> 16) + (at & 127) - 1 + width, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                data = data[~gone]
            rows.append((len(flat[offsets[k] : offsets[k + 1]]), removed, spans, hashlib.sha256(data.tobytes()).hexdigest()))
        n, removed, spans, digest = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(3), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """doc_id, text and ``doc``, a key without nulls in the order of documents; whether rows can share a key.

    The id serves as the key where it is unique; only otherwise are rows numbered.
    """
    docs = docs.select("doc_id", "text")
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.withColumn("doc", F.col("doc_id")), False
    named = docs.select(F.col("doc_id").alias("k"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("t")).distinct()
    order = F.struct(F.col("k").isNull().alias("none"), "k", "t")
    number = scratch.table(count_windows(named, order, 1).withColumnRenamed("window_no", "doc"), "numbers")
    on = F.col("doc_id").eqNullSafe(F.col("k")) & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("t"))
    return docs.join(number, on).select("doc_id", "text", "doc"), True


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs`` (doc_id, text)."""
    if not 2 * gram <= width <= gram + 100:
        raise ValueError("a gram has at most half a window, and a record at most 101 windows")
    scratch = Scratch(docs.sparkSession, "substrings")
    docs, shared = _numbered(docs, scratch)
    once = docs.dropDuplicates(["doc"]) if shared else docs
    records = once.select("doc", "text").mapInArrow(lambda b: _records(b, width, gram), _RECORD)
    marks = scratch.table(_sorted(records, single=False), "marks")
    opened = marks.filter("open")
    # At most one row for each ``block`` records; broadcast, so the records of a hot gram stay in their tasks.
    hot = scratch.table(opened.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("h", F.lit(True).alias("hot")), "hot")
    opened = opened.join(F.broadcast(hot), "h", "left").select("doc", F.struct("h", "at", F.coalesce("hot", F.lit(False)).alias("hot")).alias("at"))
    dealt = docs.select("doc", "text", "doc_id").repartition("doc")  # one exchange for all joins
    lists = lambda df: df.groupBy("doc").agg(F.collect_list("at").alias("marks"))
    marked = dealt.join(lists(opened), "doc", "left").select("doc", "text", "marks")
    texts = marked.mapInArrow(lambda b: _texts(b, width), "h long, doc long, at long, text binary")
    blocks = texts.repartition("h").sortWithinPartitions("h").mapInArrow(lambda b: _blocks(b, width, gram), "doc long, at long")
    gone = marks.filter("not open").select("doc", "at").union(blocks)
    if not hot.isEmpty():
        windows = marked.mapInArrow(lambda b: _windows(b, width), _RECORD)
        gone = gone.union(_sorted(windows, single=True).select("doc", "at"))
    result = dealt.join(lists(gone), "doc", "left").select("doc", "text", "marks", "doc_id")
    return result.mapInArrow(lambda b: _cut(b, width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: The same in DuckDB SQL: all windows of all texts, in hexadecimal digits.
REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, dense_rank() OVER (ORDER BY doc_id NULLS LAST, sha256(coalesce(text, ''))) AS n, strlen(coalesce(text, '')) AS size, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
parts AS (SELECT n, size, unnest(range(0, greatest(size - 99, 0), 200)) AS begin, x FROM (SELECT DISTINCT n, size, x FROM d)),
cut AS (SELECT n, size, begin, substr(x, CAST(2 * begin + 1 AS BIGINT), 598) AS x FROM parts),
w AS (SELECT n, begin + k AS pos, substr(x, CAST(2 * k + 1 AS BIGINT), 200) AS window_hex FROM (SELECT n, size, begin, x, unnest(range(0, least(200, size - 99 - begin))) AS k FROM cut)),
again AS (SELECT n, pos FROM (SELECT n, pos, row_number() OVER (PARTITION BY window_hex ORDER BY n, pos) AS place FROM w) WHERE place > 1),
islands AS (SELECT n, pos, sum(fresh) OVER (PARTITION BY n ORDER BY pos) AS island FROM (SELECT n, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY n ORDER BY pos) + 100 THEN 0 ELSE 1 END AS fresh FROM again)),
gone AS (SELECT n, min(pos) AS a, max(pos) + 100 AS b FROM islands GROUP BY n, island),
edges AS (SELECT n, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM gone GROUP BY n),
kept AS (SELECT doc_id, size, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN a IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(a) + 2), lambda k: substr(x, CASE WHEN k = 1 THEN 1 ELSE 2 * b[k - 1] + 1 END, 2 * (CASE WHEN k > len(a) THEN size ELSE a[k] END - CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END))), '') END AS y
  FROM d LEFT JOIN edges USING (n))
SELECT doc_id, CAST(size AS BIGINT) AS n_bytes, n_removed, n_spans, sha256(unhex(y)) AS kept_sha256 FROM kept
"""
