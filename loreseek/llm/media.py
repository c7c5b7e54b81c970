"""Telephony audio columns: mu-law, A-law and ADPCM in WAV containers.

A payload becomes the data of a WAV file, byte for byte: as 8-bit mu-law or
A-law samples, or as the 4-bit codes of IMA ADPCM blocks whose headers start
each block at zero. The three codings take turns by the payload's crc32.
Reading parses the container again. Decoding expands mu-law and A-law by
lookup tables and runs ADPCM step by step across all blocks of many files at
once; ``resampled`` doubles the rate by linear interpolation, and ``store_pcm``
writes the resampled PCM as a table, from which the features are computed.

PCM is stored without loss as two columns: the even samples (of ADPCM their
differences, which repeat more), and what the odd samples differ by from the
mean of their neighbours - of interpolated PCM nothing but its last sample, so
that the second column costs almost no space. ``stored_pcm`` gives all samples
back, of any PCM.

Defined results: a null text counts as empty; equal payloads give equal media;
repeated rows are returned once each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loreseek.llm.common import pieces
from loreseek.sources.shared import Scratch, writing

RATE = 8000
ZSTD, PAGE = 12, 8 << 20  # level and page size of both tables
UNIT = 192  # a payload is a multiple of so many bytes
CODINGS = ("mulaw", "alaw", "adpcm")
_TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 255
    magnitude = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -magnitude, magnitude).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 85
    exponent, mantissa = a >> 4 & 7, (a & 15) << 4
    magnitude = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(a & 128, magnitude, -magnitude).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()
_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: The change of the predictor for each step index and code.
_CHANGES = np.array([[(1 - 2 * (c >> 3)) * ((s >> 3) + (s >> 2) * (c & 1) + (s >> 1) * (c >> 1 & 1) + s * (c >> 2 & 1)) for c in range(16)] for s in _STEPS.tolist()], np.int32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes, filled with blanks up to a positive multiple of UNIT, and how many there were."""
    data = (text or "").encode()
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)), len(data)


def encode(payload: bytes, coding: str) -> bytes:
    """A WAV file that holds the payload."""
    if coding == "adpcm":
        blocks = np.zeros((len(payload) // UNIT, UNIT + 4), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, align, bits, samples = blocks.tobytes(), UNIT + 4, 4, len(blocks) * (2 * UNIT + 1)
        extra = struct.pack("<HH", 2, 2 * UNIT + 1)
    else:
        data, align, bits, samples, extra = payload, 1, 8, len(payload), struct.pack("<H", 0)
    rate = RATE if coding != "adpcm" else RATE * align // (2 * UNIT + 1)
    form = struct.pack("<HHIIHH", _TAGS[coding], 1, RATE, rate, align, bits) + extra
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in ((b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", data)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> tuple[str, bytes]:
    """The coding and the data of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, data = 12, 0, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return next(k for k, v in _TAGS.items() if v == tag), data


def stored_payload(coding: str, data: bytes) -> bytes:
    if coding != "adpcm":
        return data
    return np.frombuffer(data, np.uint8).reshape(-1, UNIT + 4)[:, 4:].tobytes()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks (uint8, one block a row), all blocks at once."""
    n = len(blocks)
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(head[:, 2].astype(np.int32), 0, 88)
    codes = np.empty((2 * (blocks.shape[1] - 4), n), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, n), np.int16)
    out[0] = value
    for k, code in enumerate(codes):
        value = np.clip(value + _CHANGES[index, code], -32768, 32767)
        index = np.clip(index + _MOVES[code], 0, 88)
        out[k + 1] = value
    return out.T


def decode_all(files: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """PCM of each (coding, data); the ADPCM blocks of all files are decoded together."""
    place = [k for k, (coding, _) in enumerate(files) if coding == "adpcm"]
    out = [(MULAW if coding == "mulaw" else ALAW)[np.frombuffer(data, np.uint8)] if coding != "adpcm" else np.zeros(0, np.int16) for coding, data in files]
    if place:
        blocks = [np.frombuffer(files[k][1], np.uint8).reshape(-1, UNIT + 4) for k in place]
        pcm, at = decode_adpcm(np.concatenate(blocks)), 0
        for k, own in zip(place, blocks, strict=True):
            out[k] = pcm[at : at + len(own)].reshape(-1)
            at += len(own)
    return out


def resampled(pcm: np.ndarray) -> np.ndarray:
    """The PCM at twice the rate: each sample, then the mean with the next one (the last stands twice)."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    if len(pcm):
        wide = pcm.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = pcm[-1]
    return out


def pcm_columns(pcm: np.ndarray, differences: bool) -> tuple[bytes, bytes]:
    """The even samples, or their differences, and the odd samples' differences from the mean of their neighbours; modulo 2**16."""
    even, odd = pcm[0::2], pcm[1::2]
    return (np.diff(even, prepend=np.int16(0)) if differences else even).astype("<i2").tobytes(), (odd - _means(even, len(odd))).astype("<i2").tobytes()


def stored_pcm(even: bytes, odd: bytes, differences: bool) -> np.ndarray:
    first, rest = np.frombuffer(even, "<i2"), np.frombuffer(odd, "<i2")
    first = np.cumsum(first, dtype=np.int16) if differences else first
    out = np.empty(len(first) + len(rest), np.int16)
    out[0::2], out[1::2] = first, rest + _means(first, len(rest))
    return out


def _means(even: np.ndarray, many: int) -> np.ndarray:
    """The mean of each even sample and the next one, for ``many`` odd samples; after the last there is itself."""
    wide = even.astype(np.int32)
    return ((wide + np.r_[wide[1:], wide[-1:]]) >> 1)[:many].astype(np.int16)


_MEDIA = "doc_id long, n_bytes long, media binary"
_PCM = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, coding string, rate int, even binary, odd binary"


def _write(df: DataFrame, path: str) -> None:
    # Large pages, as each is compressed alone, and no dictionary of whole files.
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": ZSTD, "parquet.page.size": PAGE, "parquet.page.row.count.limit": 1_000_000, "parquet.enable.dictionary": "false"}
    with writing(df.sparkSession):
        df.write.options(**options).parquet(path)


def _batch(rows: list[tuple], shape: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split(" ") for x in shape.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def store(docs: DataFrame, path: str) -> None:
    """Writes (doc_id, n_bytes, media) of each row of ``docs`` (doc_id, text) as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload, size = payload_of(text)
                rows.append((doc_id, size, encode(payload, CODINGS[zlib.crc32(payload) % 3])))
            yield _batch(rows, _MEDIA)

    _write(docs.select("doc_id", "text").mapInArrow(run, _MEDIA), path)


def store_pcm(media: DataFrame, path: str) -> None:
    """Reads a media table and writes, for each row, what its stored bytes are and its decoded and resampled 16-bit PCM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20, "media"):
            stored = batch.column(2).to_pylist()
            files = [parse(m) for m in stored]
            rows: list[tuple] = []
            for doc_id, size, media, (coding, data), pcm in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), stored, files, decode_all(files), strict=True):
                payload = stored_payload(coding, data)
                facts = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()
                rows.append((doc_id, size, *facts, coding, 2 * RATE, *pcm_columns(resampled(pcm), coding == "adpcm")))
            yield _batch(sorted(rows, key=lambda r: r[7]), _PCM)  # PCM of one coding repeats itself more than that of others

    _write(media.select("doc_id", "n_bytes", "media").mapInArrow(run, _PCM), path)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(pcm: DataFrame) -> DataFrame:
    """What the contract asks for, from a table of ``store_pcm``: of the PCM its coding, samples, peak, root mean square, crossings of zero, and checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20, "even"):
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                coding, _, even, odd = row[7:]
                samples = stored_pcm(even, odd, coding == "adpcm")
                wide = samples.astype(np.int64)
                crossings = int(((samples[1:] < 0) != (samples[:-1] < 0)).sum())
                rows.append((*row[:7], f"{coding}:{len(samples)}:{int(np.abs(wide).max())}:{int(np.sqrt(wide @ wide / len(wide)))}:{crossings}:{zlib.crc32(samples.astype('<i2').tobytes()):08x}"))
            yield _batch(rows, _FEATURES)

    return pcm.select(*[x.split(" ")[0] for x in _PCM.split(", ")]).mapInArrow(run, _FEATURES)


def through_media(docs: DataFrame) -> DataFrame:
    """Stores the media of ``docs`` (doc_id, text) in the shared folder, then their PCM, and reads that back as features."""
    spark = docs.sparkSession
    path = Scratch(spark, "media").path
    store(docs, f"{path}/media")
    store_pcm(spark.read.schema(_MEDIA).parquet(f"{path}/media"), f"{path}/pcm")
    return features(spark.read.schema(_PCM).parquet(f"{path}/pcm"))
