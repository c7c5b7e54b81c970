"""Quality classifier: ridge regression on random Fourier features, calibrated isotonically.

Each whole text is reduced to ``STATS`` numbers. Random Fourier features
approximate a Gaussian kernel over the standardised numbers; the normal
equations are summed within partitions, then by row over partitions, so the
driver gets one matrix of fixed size. Scores of the training rows are counted
in fixed bins, and pool-adjacent-violators over the bins gives the calibration.
Every labelled row outside the held-out third takes part; nothing is sampled.

Held out are rows whose crc32(doc_id as text) modulo 3 is 1. Labels, language,
source and id are never inputs of a score.

Defined results: a null text counts as empty and gets a score like any other; a
null id is not held out and matches no label; several labels of one id are
averaged, null labels are ignored; without any label each score is 0.5;
repeated rows are returned once each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreseek.llm.common import pieces
from loreseek.sources.shared import Scratch

FEATURES = 256
RIDGE = 1e-3  # times the number of rows
BINS = 1000
TREE = 256  # tasks whose sums are added first, before the sums of such groups
_LOW, _HIGH = -0.5, 1.5  # raw scores beyond are counted in the outer bins

STATS = (
    "log_bytes", "log_words", "word_length", "letters", "capitals", "digits", "stops", "symbols", "blanks", "lines",
    "exclamations", "bars", "same_as_previous", "distinct_words", "distinct_lines", "packed", "sentence_words", "longest_word",
)

_KIND = np.zeros((256, 9), np.uint8)  # letters, capitals, digits, stops, symbols, blanks, new lines, !, |
for _b in range(256):
    _c = chr(_b)
    _letter = _b >= 128 or _c.isalpha()
    _blank = _b == 32 or 9 <= _b <= 13
    _KIND[_b] = [_letter, _b < 128 and _c.isupper(), _b < 128 and _c.isdigit(), _c in ".,;:?'\"-", not _letter and not _blank and not (_b < 128 and _c.isdigit()) and _c not in ".,;:?'\"-", _blank, _b == 10, _c == "!", _c == "|"]


def statistics(data: bytes) -> list[float]:
    """The numbers of one whole text (UTF-8), in the order of STATS."""
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _KIND.astype(np.int64)
    letters, capitals, digits, stops, symbols, blanks, lines, bangs, bars = counts.tolist()
    words = data.split()
    many = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    rows = [x for x in data.split(b"\n") if x]
    ends = data.count(b".") + data.count(b"?") + data.count(b"!")
    return [
        np.log1p(len(data)), np.log1p(len(words)), (len(data) - blanks) / many, letters / n, capitals / max(1, letters), digits / n, stops / n, symbols / n, blanks / n, lines / n,
        bangs / n, bars / n, same / many, len(set(words)) / many, len(set(rows)) / max(1, len(rows)), len(zlib.compress(data, 1)) / (n + 16), np.log1p(len(words) / (1 + ends)), np.log1p(max(map(len, words), default=0)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            rows = [statistics((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def is_held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _projection() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    spread = np.sqrt(len(STATS)) * 0.7
    return rng.normal(0, 1 / spread, (len(STATS), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


_W, _SHIFT = _projection()


@dataclass
class Model:
    """mean and spread standardise the statistics; weights belong to the features and the constant; the rest is the calibration."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    centres: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ _W + _SHIFT), np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.clip(np.interp(self.raw(x), self.centres, self.values), 0, 1), 6)


def isotonic(centres: np.ndarray, totals: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over weighted points in rising order: centre and value of each pool."""
    pools: list[list[float]] = []
    for c, n, y in zip(centres.tolist(), totals.tolist(), ones.tolist(), strict=True):
        pools.append([c * n, n, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools, float)
    return p[:, 0] / p[:, 1], p[:, 2] / p[:, 1]


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fits on the labelled rows of ``stats`` (doc_id, x) that are not held out."""
    size, d = FEATURES + 1, len(STATS)
    truth = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y"))
    train = stats.filter(~is_held_out()).join(truth, "doc_id").select("x", "y")
    train = Scratch(stats.sparkSession, "training").table(train, "rows")  # read three times
    model = Model(np.zeros(d), np.ones(d), np.zeros(size), np.zeros(1), np.full(1, 0.5))
    moments = train.agg(F.count("*").alias("n"), *[f(F.col("x")[k]).alias(f"{f.__name__}{k}") for k in range(d) for f in (F.avg, F.stddev_pop)]).first()
    if not moments["n"]:
        return model
    model.mean = np.array([moments[f"avg{k}"] for k in range(d)])
    model.spread = np.maximum(np.array([moments[f"stddev_pop{k}"] for k in range(d)]), 1e-6)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                z = model.features(np.stack(part["x"].to_numpy()))
                total += z.T @ np.hstack([z, part["y"].to_numpy()[:, None]])
        if total.any():
            yield pd.DataFrame({"i": np.arange(size), "part": TaskContext.get().partitionId(), "row": list(total)})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")  # the same sums in each run
        return pd.DataFrame({"i": rows["i"].iloc[:1], "part": rows["part"].iloc[:1], "row": [np.stack(rows["row"].to_numpy()).sum(axis=0)]})

    shape = "i int, part int, row array<double>"
    branches = train.mapInPandas(sums, shape).groupBy("i", F.floor(F.col("part") / TREE)).applyInPandas(add, shape)
    rows = branches.groupBy("i").applyInPandas(add, shape).orderBy("i").collect()
    total = np.array([r["row"] for r in rows])
    penalty = RIDGE * moments["n"] * np.eye(size)
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(total[:, :-1] + penalty + 1e-9 * np.eye(size), total[:, -1])

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = model.raw(np.stack(batch["x"].to_numpy()))
                at = np.clip((raw - _LOW) / (_HIGH - _LOW) * BINS, 0, BINS - 1).astype(np.int32)
                yield pd.DataFrame({"bin": at, "y": batch["y"].to_numpy()})

    counted = train.mapInPandas(bins, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()
    at, n, ones = (np.array([r[k] for r in counted], float) for k in ("bin", "n", "ones"))
    model.centres, model.values = isotonic(_LOW + (at + 0.5) * (_HIGH - _LOW) / BINS, n, ones)
    return model


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text)."""
    stats = Scratch(docs.sparkSession, "quality").table(document_statistics(docs), "statistics")
    model = fit(stats, labels, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                score = np.concatenate([model.score(x[k : k + 4096]) for k in range(0, len(x), 4096)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    model = fit(Scratch(docs.sparkSession, "quality").table(document_statistics(docs), "statistics"), labels, label)
    schema, place = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            x = np.array([statistics((t or "").encode()) for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(run, schema)
