"""Chunkers: the whole file, and fixed windows of whole lines with overlap."""

from __future__ import annotations

from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loreseek.functions.text import end_line
from loreseek.schemas import CHUNKS

WINDOW, OVERLAP = 1500, 200
PIECE = 1 << 20
_ARROW = pa.list_(pa.struct([("content", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("strategy", pa.string()), ("symbol", pa.string())]))


class Chunker(Protocol):
    def chunk(self, text: str, path: str) -> list[tuple[str, int, int, str, None]]: ...


def _units(line: str) -> int:
    return len(line) if line.isascii() else len(line.encode("utf-16-le", "surrogatepass")) // 2


def fixed_spans(text: str, window: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(first line, last line) of each window, 1-based.

    A window takes lines until they come to ``window`` UTF-16 units, line feeds counted; the next one starts
    on the line that brings the window to all but ``overlap`` of its units, and at least one line later.
    """
    window = max(1, window)
    overlap = min(max(0, overlap), window - 1)
    sizes = [_units(x) + 1 for x in text.split("\n")]
    spans, start = [], 0
    while True:
        end = total = 0
        for end in range(start, len(sizes)):
            total += sizes[end]
            if total >= window:
                break
        spans.append((start + 1, end + 1))
        if end + 1 >= len(sizes):
            return spans
        passed, landing = 0, start
        for landing in range(start, end + 1):
            passed += sizes[landing]
            if passed >= total - overlap:
                break
        start = max(start + 1, landing)


class FixedChunker:
    def __init__(self, window: int = WINDOW, overlap: int = OVERLAP) -> None:
        self.window, self.overlap = window, overlap

    def chunk(self, text: str, path: str = "") -> list[tuple[str, int, int, str, None]]:
        lines = text.split("\n")
        return [("\n".join(lines[a - 1 : b]), a, b, "fixed", None) for a, b in fixed_spans(text, self.window, self.overlap)]


class FileChunker:
    def chunk(self, text: str, path: str = "") -> list[tuple[str, int, int, str, None]]:
        return [(text, 1, text.count("\n") + 1, "file", None)]


def file_chunks(text: Column) -> Column:
    """The whole text as one chunk, without Python."""
    return F.array(F.struct(text.alias("content"), F.lit(1).alias("start_line"), end_line(text).alias("end_line"), F.lit("file").alias("strategy"), F.lit(None).cast("string").alias("symbol")))


def cut(texts: pa.Array, chunker: Chunker) -> pa.Array:
    """The chunks of each text. What has been cut becomes Arrow's after each ``PIECE`` characters, so Python holds a text and a piece, not a batch."""
    done, each, held = [], [], 0
    for text in texts:
        each.append(chunker.chunk(text.as_py(), "") if text.is_valid else [])
        held += sum(len(c[0]) for c in each[-1])
        if held >= PIECE:
            done.append(pa.array(each, _ARROW))
            each, held = [], 0
    return pa.concat_arrays([*done, pa.array(each, _ARROW)])


def chunks(text: Column, chunker: Chunker | None = None) -> Column:
    """array of chunks of a chunker, by Arrow batches (see ``bound_batches``); a null text has none. Lines carry over, so this is no window function."""
    chunker = chunker or FixedChunker()

    @F.arrow_udf(CHUNKS)
    def run(texts: pa.Array) -> pa.Array:
        return cut(texts, chunker)

    return run(text)
