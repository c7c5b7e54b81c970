"""Telephony audio: exact round trips, and decoders against step-by-step ones."""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib

import numpy as np
import pytest

from loreseek.llm import media
from tests.llm.conftest import edge_rows


@pytest.mark.parametrize("coding", media.CODINGS)
@pytest.mark.parametrize("size", [192, 384, 192 * 50])
def test_round_trip(coding, size):
    payload = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    kind, data = media.parse(media.encode(payload, coding))
    assert kind == coding and media.stored_payload(kind, data) == payload


def test_container_is_a_wav_file():
    stored = media.encode(b"x" * 192, "mulaw")
    assert struct.unpack_from("<I", stored, 4)[0] == len(stored) - 8
    with pytest.raises(wave.Error):  # the standard reader takes PCM only, and names the coding it finds
        wave.open(io.BytesIO(stored))


def test_expansion_tables():
    """Fixed points of the published codings, and their symmetry."""
    assert media.MULAW[[0x00, 0x80, 0x7F, 0xFF]].tolist() == [-32124, 32124, 0, 0]
    assert media.ALAW[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    assert (media.MULAW[:128] == -media.MULAW[128:]).all() and (media.ALAW[:128] == -media.ALAW[128:]).all()


def one_block(block: bytes) -> list[int]:
    """IMA ADPCM as published, sample by sample."""
    value, index = struct.unpack_from("<hB", block)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media._STEPS[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def test_adpcm_blocks_together_as_one_by_one():
    blocks = np.random.default_rng(3).integers(0, 256, (20, 196), dtype=np.uint8)
    blocks[:, 2] %= 89
    found = media.decode_adpcm(blocks)
    assert [one_block(b.tobytes()) for b in blocks] == found.tolist()


def test_step_table_grows_by_a_tenth():
    assert all(1.08 < b / a < 1.15 or b - a <= 2 for a, b in zip(media._STEPS.tolist(), media._STEPS.tolist()[1:]))


def test_resampling():
    assert media.resampled(np.array([0, 10, -10], np.int16)).tolist() == [0, 5, 10, 0, -10, -10]
    assert media.resampled(np.zeros(0, np.int16)).tolist() == []


def test_query_columns(edges, nothing):
    rows = media.through_media(edges).collect()
    assert len(rows) == len(edge_rows())
    texts = sorted(((r[0], r[1]) for r in edge_rows()), key=str)
    seen = {}
    for (doc_id, text), r in zip(texts, sorted(rows, key=lambda r: str((r["doc_id"], next(t for i, t in texts if i == r["doc_id"])))), strict=True):
        data = (text or "").encode()
        if doc_id is None:
            continue
        padded = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (doc_id, len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-16:])
        stored = media.encode(padded, media.CODINGS[zlib.crc32(padded) % 3])
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert seen.setdefault(padded, r["feature"]) == r["feature"]
    assert media.through_media(nothing).count() == 0


def test_stored_pcm(spark, edges, tmp_path):
    path = f"file://{tmp_path}"
    media.store(edges, f"{path}/media")
    media.store_pcm(spark.read.parquet(f"{path}/media"), f"{path}/pcm")
    rows = spark.read.parquet(f"{path}/pcm").collect()
    assert len(rows) == len(edge_rows()) and {r["rate"] for r in rows} == {16000}
    stored = {r["doc_id"]: bytes(r["media"]) for r in spark.read.parquet(f"{path}/media").filter("doc_id is not null").collect()}
    for r in rows:
        if r["doc_id"] is not None:
            pcm = media.decode_all([media.parse(stored[r["doc_id"]])])[0]
            assert np.array_equal(media.stored_pcm(bytes(r["even"]), bytes(r["odd"]), r["coding"] == "adpcm"), media.resampled(pcm))
            assert not any(bytes(r["odd"])[:-2])  # interpolated samples cost no space


@pytest.mark.parametrize("differences", [False, True])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 1001])
def test_any_pcm_comes_back(n, differences):
    pcm = np.random.default_rng(n).integers(-32768, 32768, n).astype(np.int16)
    assert np.array_equal(media.stored_pcm(*media.pcm_columns(pcm, differences), differences), pcm)
