"""Scalar functions: chunks, hashes, vectors, text, scores, providers."""

from __future__ import annotations

import json
import math
import threading
import tracemalloc
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from loreseek.functions import chunking, embedding, scores, text
from loreseek.functions.hashing import git_blob_hash, utf16_length
from loreseek.functions.vectors import cosine, cosine_quantized, dequantize, literal, quantize
from loreseek.plans import queries
from loreseek.schemas import CHUNKS
from loreseek.sources import shared


def one(spark, column, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


# -- chunks


@pytest.mark.parametrize(
    ("lines", "window", "overlap", "spans"),
    [
        ([f"line number {k} here!" for k in range(1, 51)], 200, 40, [(1, 10), (9, 18), (17, 26), (25, 34), (33, 42), (41, 50)]),
        (["x" * 15] * 30, 100, 20, [(1, 7), (6, 12), (11, 17), (16, 22), (21, 27), (26, 30)]),
        (["x" * 10] * 20, 10, 999, [(k, k) for k in range(1, 21)]),
        (["x" * 24] * 100, 1500, 200, [(1, 60), (52, 100)]),
        (["x" * 24] * 100, 800, 200, [(1, 32), (24, 55), (47, 78), (70, 100)]),
        (["y" * 5000], 1500, 200, [(1, 1)]),
        ([""], 1500, 200, [(1, 1)]),
    ],
)
def test_fixed_spans(lines, window, overlap, spans):
    assert chunking.fixed_spans("\n".join(lines), window, overlap) == spans


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab😀", max_size=30), min_size=1, max_size=40), st.integers(-3, 80), st.integers(-3, 90))
def test_fixed_spans_cover_all_lines_and_advance(lines, window, overlap):
    spans = chunking.fixed_spans("\n".join(lines), window, overlap)
    assert spans[0][0] == 1 and spans[-1][1] == len(lines)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b + 1 and b <= d


def test_astral_characters_count_twice():
    assert chunking.fixed_spans("😀😀😀\nx", 7, 0) == [(1, 1), (2, 2)] and chunking.fixed_spans("abc\nx", 7, 0) == [(1, 2)]


def test_cutting_holds_a_piece_of_a_batch():
    """A batch of 12 MB is cut with a few MB of Python objects; a session's batches are bounded, too."""
    texts = pa.array([*(("word " * 19 + f"{k}\n") * 40 for k in range(3_000)), None, ""])
    tracemalloc.start()
    found = chunking.cut(texts, chunking.FixedChunker(800))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 << 20
    wanted = chunking.FixedChunker(800).chunk(texts[7].as_py())
    assert [tuple(c.values()) for c in found[7].as_py()] == wanted and len(wanted) > 5
    assert len(found) == 3_002 and found[3_000].as_py() == [] and len(found[3_001].as_py()) == 1


@pytest.mark.parametrize("window", [800, 1500])
def test_batches_of_texts_to_cut_are_bounded(spark, tmp_path, window, monkeypatch):
    spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "'s' source", "'l' lang", "repeat('x', 20000) text").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(shared._BATCH, None)
    spark.conf.unset(shared._BATCH)

    class Counting:
        def __init__(self, window):
            self.window = window

    def chunks(text, chunker):
        @F.arrow_udf(CHUNKS)
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([[("", len(texts), chunker.window, "", None)]] * len(texts), chunking._ARROW)

        return run(text)

    monkeypatch.setattr(queries, "chunks", chunks)
    monkeypatch.setattr(queries, "FixedChunker", Counting)
    try:
        found = queries.QUERIES[f"fixed_chunks_{window}"](spark, str(tmp_path)).agg(F.max("start_line"), F.max("end_line"), F.count("*")).first()
    finally:
        spark.conf.set(shared._BATCH, before) if before else spark.conf.unset(shared._BATCH)
    assert found[0] < 500 and tuple(found)[1:] == (window, 3000)


def test_chunks_of_a_column(spark):
    df = spark.createDataFrame([("a\nb\n",), ("",), (None,)], "t string")
    whole = [r[0] for r in df.select(chunking.file_chunks(F.col("t"))[0]["end_line"]).collect()]
    assert whole == [3, 1, None]
    cut = [r[0] for r in df.select(chunking.chunks(F.col("t"), chunking.FixedChunker(2, 0))).collect()]
    assert [(c["content"], c["start_line"], c["end_line"], c["strategy"]) for c in cut[0]] == [("a", 1, 1, "fixed"), ("b", 2, 2, "fixed"), ("", 3, 3, "fixed")]
    assert len(cut[1]) == 1 and cut[2] == []
    assert chunking.FileChunker().chunk("a\nb\n")[0][1:3] == (1, 3)


# -- hashes


def test_git_object_id(spark):
    assert one(spark, git_blob_hash(F.lit("hello"))) == "b6fc4c620b67d95f953a5c1c1230aaab5db5a1b0"
    assert one(spark, utf16_length(F.lit("a😀"))) == 3


# -- vectors


def numpy_quantized(v):
    v = np.array(v, np.float32)
    spread = np.float32(v.max() - v.min()) or np.float32(1)
    scale = np.float32(spread / np.float32(255))
    return v.min(), scale, np.clip(np.rint((v - v.min()) / scale) - 128, -128, 127).astype(int).tolist()


def test_quantised_as_in_single_precision(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=256).astype(np.float32).tolist()) for k in range(20)] + [(20, [0.5] * 16), (21, [0.0] * 4)]
    df = spark.createDataFrame(rows, "k int, v array<float>").select("k", "v", quantize(F.col("v")).alias("q"))
    back = df.select("k", "v", "q", dequantize(F.col("q.q_min"), F.col("q.q_scale"), F.col("q.q_data")).alias("back"), cosine_quantized(F.col("v"), F.col("q.q_min"), F.col("q.q_scale"), F.col("q.q_data")).alias("c"))
    for r in back.collect():
        low, scale, data = numpy_quantized(r["v"])
        assert (r["q"]["q_min"], r["q"]["q_scale"], r["q"]["q_data"]) == (pytest.approx(float(low)), pytest.approx(float(scale)), data)
        if r["k"] < 20:
            assert r["c"] > 0.98
        assert all(math.isfinite(x) for x in r["back"])


def test_cosine(spark):
    assert one(spark, cosine(literal([1, 0]), literal([2, 0]))) == 1.0
    assert one(spark, cosine(literal([1, 0]), literal([0, 0]))) == 0.0
    assert one(spark, cosine(literal([1, 0]), literal([-1, 0]))) == -1.0


# -- text


@pytest.mark.parametrize(("query", "path", "wanted"), [("auth", "src/auth/oauth.ts", 1.0), ("auth missing", "src/auth/oauth.ts", 0.5), ("nothing matches", "src/auth/oauth.ts", 0.0), ("", "src/a", 0.0), ("AUTH auth x", "AUTH", 2 / 3), ("foo-bar", "bar/foo", 1.0)])
def test_path_relevance(spark, query, path, wanted):
    assert one(spark, text.path_relevance(F.lit(query), F.lit(path))) == pytest.approx(wanted)
    assert one(spark, text.best_path_relevance(F.lit(query), F.array(F.lit("zzz"), F.lit(path)))) == pytest.approx(wanted)


def test_no_path_has_no_relevance(spark):
    assert one(spark, text.best_path_relevance(F.lit("a"), F.array().cast("array<string>"))) == 0.0


def test_tokens_and_phrases(spark):
    assert one(spark, text.ascii_tokens(F.lit("Foo_bar-BAZ.x CAFÉ café é😀1"))) == ["foo", "bar", "baz", "x", "cafÉ", "café", "é😀1"]
    assert one(spark, text.quoted_query(F.lit('  a  b"c\td '))) == '"a" "b""c" "d"'
    assert one(spark, text.quoted_query(F.lit("   "))) == ""


@pytest.mark.parametrize(("message", "wanted"), [("maximum context length", True), ("Input LENGTH", True), ("this exceeds it", True), ("the token count is over the limit", True), ("not found", False)])
def test_context_errors(spark, message, wanted):
    assert one(spark, text.is_context_error(F.lit(message))) is wanted
    assert isinstance(embedding.refusal(400, message), embedding.ContextLengthExceeded) is wanted


def test_result_line(spark):
    assert one(spark, text.result_line(F.lit(3), F.lit(0.123456), F.lit("a/b"), F.lit("HYBRID"), F.lit("0123456789"))) == "3\t0.123456\thybrid\t0123456789\ta/b"


# -- scores


def pool_of(spark, rows, column):
    df = spark.createDataFrame(rows, "k int, v double, t long")
    return [r[0] for r in df.select(column(Window.partitionBy(F.lit(1))), "k").orderBy("k").collect()]


def test_min_max(spark):
    assert pool_of(spark, [(1, 1.0, 0), (2, 3.0, 0), (3, 2.0, 0)], lambda w: scores.min_max(F.col("v"), w)) == [0.0, 1.0, 0.5]
    assert pool_of(spark, [(1, 7.0, 0), (2, 7.0, 0)], lambda w: scores.min_max(F.col("v"), w)) == [0.5, 0.5]


def test_recency(spark):
    recent = lambda w: scores.recency(F.col("t"), w)
    assert pool_of(spark, [(1, 0.0, 1000), (2, 0.0, 2000), (3, 0.0, 3000)], recent) == [0.0, 0.5, 1.0]
    assert pool_of(spark, [(1, 0.0, 1000), (2, 0.0, None)], recent) == [None, None]
    assert pool_of(spark, [(1, 0.0, 500), (2, 0.0, 500)], recent) == [1.0, 1.0]


def test_three_signals(spark):
    null = F.lit(None).cast("double")
    assert one(spark, scores.three_signal(F.lit(1.0), null, F.lit(0.0))) == pytest.approx(0.875)
    assert one(spark, scores.three_signal(F.lit(0.0), null, F.lit(0.0))) == 0.0
    assert one(spark, scores.three_signal(F.lit(1.0), F.lit(0.5), F.lit(1.0))) == pytest.approx(0.9)
    assert one(spark, scores.three_signal(F.lit(1.0), null, F.lit(1.0), scores.Weights(0, 1, 0))) == 0.0


def test_blend(spark):
    assert one(spark, scores.blend(F.lit(0.5), F.lit(0.5))) == pytest.approx(0.5)
    assert one(spark, scores.blend(F.lit(None).cast("double"), F.lit(1.0))) == pytest.approx(0.3)
    assert one(spark, scores.blend(F.lit(1.0), F.lit(None).cast("double"), 1.0)) == 0.0


def test_coverage(spark):
    assert one(spark, scores.coverage_fraction(F.lit(0), F.lit(0))) == 0.0 and one(spark, scores.coverage_fraction(F.lit(1), F.lit(4))) == 0.25
    assert one(spark, scores.coverage_complete(F.lit(0), F.lit(0))) is False and one(spark, scores.coverage_complete(F.lit(5), F.lit(4))) is True


# -- providers


class Counting(embedding.DeterministicProvider):
    def __init__(self, **options):
        super().__init__(**options)
        self.calls = 0

    def embed(self, texts):
        self.calls += 1
        if "bad" in texts:
            raise RuntimeError("bad text")
        return super().embed(texts)


def test_batches_and_isolation():
    provider = Counting()
    assert all(v and e is None for v, e in embedding.embed_all(provider, [str(k) for k in range(20)], 5)) and provider.calls == 4
    provider = Counting(max_length=10)
    found = embedding.embed_all(provider, ["a", "bad", "b", "x" * 11, "c"], 5)
    assert [e for _, e in found] == [None, embedding.OTHER, None, embedding.CONTEXT, None]
    assert found[2][0] == embedding.digest_vector("b", 8)
    assert embedding.embed_all(provider, []) == []


def test_deterministic_vectors():
    a, b = embedding.digest_vector("alpha", 8), embedding.digest_vector("beta", 8)
    assert a == embedding.digest_vector("alpha", 8) != b and np.linalg.norm(a) == pytest.approx(1, abs=1e-6)


def test_embed_column_never_raises(spark):
    df = spark.createDataFrame([("a",), ("x" * 50,), (None,)], "t string")
    rows = [r[0] for r in df.select(embedding.embed(F.col("t"), embedding.DeterministicProvider(max_length=10))).collect()]
    assert [r["error"] for r in rows] == [None, "context", None] and rows[1]["vector"] is None and len(rows[0]["vector"]) == 8


class Endpoint(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.server.seen.append((self.path, body, self.headers.get("Authorization")))
        status, answer = 200, {"embedding": [1.0, 2.0, 3.0]}
        if self.path == "/v1/embeddings":
            answer = {"data": [{"index": k, "embedding": [float(k), 1.0]} for k in range(len(body["input"]))][::-1]}
            if "drop" in body["input"]:
                answer["data"].pop()
        if "too long" in json.dumps(body):
            status, answer = 400, {"error": "input is too long"}
        if "broken" in json.dumps(body):
            answer = {"error": "?"}
        data = json.dumps(answer).encode()
        self.send_response(status)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def endpoint():
    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    server.seen = []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    server.url = f"http://127.0.0.1:{server.server_port}"
    yield server
    server.shutdown()


def test_one_prompt_a_call(endpoint):
    provider = embedding.HttpProvider.create(endpoint.url, "m")
    assert provider.dimensions == 3 and provider.embed(["a", "b"]) == [[1.0, 2.0, 3.0]] * 2 and len(endpoint.seen) == 3
    assert provider.embed([]) == [] and len(endpoint.seen) == 3


def test_batch_is_put_in_order_of_index(endpoint):
    provider = embedding.HttpProvider.create(endpoint.url, "m", "openai", "key")
    assert provider.embed(["a", "b", "c"]) == [[0.0, 1.0], [1.0, 1.0], [2.0, 1.0]]
    assert endpoint.seen[-1] == ("/v1/embeddings", {"model": "m", "input": ["a", "b", "c"]}, "Bearer key")
    with pytest.raises(embedding.EmbeddingProtocolError):
        provider.embed(["a", "drop"])


def test_failures_of_the_endpoint(endpoint):
    provider = embedding.HttpProvider(endpoint.url, "m", 3)
    with pytest.raises(embedding.ContextLengthExceeded):
        provider.embed(["too long"])
    with pytest.raises(embedding.EmbeddingProtocolError):
        provider.embed(["broken"])
    with pytest.raises(embedding.EmbeddingProtocolError):
        embedding.OfflineProvider("m").embed(["a"])
