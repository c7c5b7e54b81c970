"""DuckDB SQL for the registered queries. It follows the same reading of the semantics as the plans; fixed cases in the tests hold both."""

from __future__ import annotations

from loreseek.functions.porter import STEP2, STEP3, STEP4

_BLOBS = "b AS (SELECT doc_id, sha1(text) AS blob_hash, source || '/' || lang || '/' || doc_id || '.txt' AS path, source AS branch, text AS content FROM documents)"
_CONTENTS = "c AS (SELECT blob_hash, any_value(content) AS content FROM b GROUP BY blob_hash)"
_INDEXED = "i AS (SELECT DISTINCT blob_hash FROM b WHERE doc_id IN (SELECT doc_id FROM labels))"
#: UTF-16 units: code points, and one more for each beyond the basic plane.
_UNITS = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"
_END_LINE = "len(string_split({0}, chr(10)))"


def _epoch(column: str) -> str:
    return f"CAST(floor(epoch({column})) AS BIGINT)"


# -- chunks


def _spans(windows: str, overlap: int = 200) -> str:
    """CTEs up to s (blob_hash, w, chunk_index, a, z, n_chars): the windows of lines of table t (blob_hash, content)."""
    return f"""
u AS (SELECT blob_hash, string_split(content, chr(10)) AS lines FROM t),
n AS (SELECT blob_hash, len(lines) AS many, list_transform(lines, lambda x: {_UNITS.format('x')} + 1) AS units, list_transform(lines, lambda x: length(x) + 1) AS points FROM u),
w AS (SELECT unnest([{windows}]) AS w),
m AS (
  SELECT blob_hash, w, many, list_transform(range(1, many + 1), lambda k: CAST(list_sum(units[1:k]) AS BIGINT)) AS upto, list_transform(range(1, many + 1), lambda k: CAST(list_sum(points[1:k]) AS BIGINT)) AS chars FROM n, w),
r(blob_hash, w, many, upto, chars, chunk_index, a, before, z) AS (
  SELECT blob_hash, w, many, upto, chars, 0, 1::BIGINT, 0::BIGINT, coalesce(list_min(list_filter(range(1, many + 1), lambda k: upto[k] >= w)), many) FROM m
  UNION ALL
  SELECT blob_hash, w, many, upto, chars, chunk_index + 1, a2, upto[a2 - 1], coalesce(list_min(list_filter(range(a2, many + 1), lambda k: upto[k] - upto[a2 - 1] >= w)), many)
  FROM (SELECT *, greatest(a + 1, list_min(list_filter(range(a, z + 1), lambda k: upto[k] - before >= upto[z] - before - {overlap}))) AS a2 FROM r WHERE z < many)),
s AS (SELECT blob_hash, w, chunk_index, a, z, chars[z] - CASE WHEN a > 1 THEN chars[a - 1] ELSE 0 END - 1 AS n_chars FROM r)"""


def _fixed(window: int) -> str:
    return f"WITH RECURSIVE {_BLOBS}, {_CONTENTS}, t AS (SELECT * FROM c), {_spans(str(window))} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(a AS INTEGER) AS start_line, CAST(z AS INTEGER) AS end_line, CAST(n_chars AS INTEGER) AS n_chars FROM b JOIN s USING (blob_hash)"


# -- vectors, in single precision where the index has it

_QUANTISED = """
e AS (SELECT vec_id, label, embedding, list_min(embedding) AS low, list_max(embedding) AS high FROM embeddings),
f AS (SELECT vec_id, label, embedding, low, CAST(CAST(CASE WHEN high = low THEN CAST(1 AS FLOAT) ELSE high - low END AS DOUBLE) / 255 AS FLOAT) AS scale FROM e),
q AS (SELECT vec_id, label, embedding, low, scale, list_transform(embedding, lambda v: greatest(-128, least(127, CAST(round_even(CAST(CAST(v - low AS DOUBLE) / scale AS FLOAT), 0) AS INTEGER) - 128))) AS data FROM f),
d AS (SELECT vec_id, label, embedding, low, scale, data, list_transform(data, lambda x: CAST(CAST(x + 128 AS FLOAT) * scale AS FLOAT) + low) AS v FROM q)"""
_SCORED = """
a AS (SELECT embedding AS asked, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS asked_length FROM embeddings WHERE vec_id = 0),
p AS (
  SELECT vec_id, label, list_sum(list_transform(list_zip(asked, v), lambda x: CAST(CAST(x[1] * x[2] AS FLOAT) AS DOUBLE))) AS dot,
    asked_length * sqrt(list_sum(list_transform(v, lambda x: CAST(CAST(x * x AS FLOAT) AS DOUBLE)))) AS length FROM d, a),
v AS (SELECT vec_id, label, CASE WHEN length > 0 THEN dot / length ELSE 0 END AS score FROM p)"""


def _topk(blob: str, where: str = "true") -> str:
    return f"WITH {_QUANTISED}, {_SCORED}, g AS (SELECT sha1(CAST({blob} AS VARCHAR)) AS blob_hash, max(score) AS score FROM v GROUP BY 1) SELECT blob_hash, round(score, 6) AS score FROM g WHERE {where} ORDER BY g.score DESC, blob_hash LIMIT 10"


# -- keyword search without stems

_TOKENS = r"""
l AS (SELECT blob_hash, list_filter(regexp_split_to_array(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda t: t <> '') AS tokens FROM c),
k AS (SELECT blob_hash, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM l),
dl AS (SELECT blob_hash, len(tokens) AS dl FROM l),
stat AS (SELECT count(*) AS docs, avg(dl) AS mean FROM dl)"""


def _counts(phrases: list[list[str]]) -> str:
    """CTEs up to hit (blob_hash, bm25): documents with all phrases."""
    parts = []
    for n, terms in enumerate(phrases):
        joins = " ".join(f"JOIN k k{i} ON k{i}.blob_hash = k0.blob_hash AND k{i}.pos = k0.pos + {i} AND k{i}.term = '{t}'" for i, t in enumerate(terms) if i)
        parts.append(f"SELECT {n} AS phrase, k0.blob_hash, count(*) AS tf FROM k k0 {joins} WHERE k0.term = '{terms[0]}' GROUP BY 2")
    return f"""
tf AS ({' UNION ALL '.join(parts)}),
idf AS (SELECT phrase, CASE WHEN ln((docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) END AS weight FROM tf, stat GROUP BY phrase, docs),
hit AS (
  SELECT blob_hash, -sum(weight * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS bm25
  FROM tf JOIN idf USING (phrase) JOIN dl USING (blob_hash), stat GROUP BY blob_hash HAVING count(*) = {len(phrases)})"""


# -- stems, step by step over the distinct terms; ``f`` is a word's form: v for vowels, # for all else

def _form(word: str) -> str:
    """A y is a vowel after a consonant, so in a row of them every other one."""
    marked = f"regexp_replace(regexp_replace({word}, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g')"
    return f"regexp_replace(regexp_replace({marked}, '[^aeiouy]', '#', 'g'), '[aeiouy]', 'v', 'g')"


_ONE, _TWO = "'v#'", "'v#.*v#'"  # at least one, two changes from vowels to consonants


def _stem_of(n: int) -> str:
    return f"left(f, length(w) - {n})"


def _short(word: str, form: str) -> str:
    return f"(ends_with({form}, '#v#') AND right({word}, 1) NOT IN ('w', 'x', 'y'))"


def _endings(table: dict[str, str], least: str, also: str = "true") -> str:
    """The longest ending of the table that is shorter than the word is replaced if the rest's form allows."""
    cases = [f"WHEN ends_with(w, '{old}') AND length(w) > {len(old)} THEN CASE WHEN regexp_matches({_stem_of(len(old))}, {least}) AND {also if old == 'ion' else 'true'} THEN left(w, length(w) - {len(old)}) || '{new}' ELSE w END" for old, new in sorted(table.items(), key=lambda x: -len(x[0]))]
    return f"CASE {' '.join(cases)} ELSE w END"


_STEPS = (
    "CASE WHEN (ends_with(w, 'sses') AND length(w) > 4) OR (ends_with(w, 'ies') AND length(w) > 3) THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END",
    # A cut leaves a mark, which the next step takes away.
    f"""CASE WHEN ends_with(w, 'eed') AND length(w) > 3 THEN CASE WHEN regexp_matches({_stem_of(3)}, {_ONE}) THEN left(w, length(w) - 1) ELSE w END
      WHEN ends_with(w, 'ed') AND contains({_stem_of(2)}, 'v') THEN left(w, length(w) - 2) || '|' WHEN ends_with(w, 'ing') AND contains({_stem_of(3)}, 'v') THEN left(w, length(w) - 3) || '|' ELSE w END""",
    f"""CASE WHEN NOT ends_with(w, '|') THEN w WHEN regexp_matches(w, '(at|bl|iz)[|]$') THEN left(w, length(w) - 1) || 'e'
      WHEN length(w) > 2 AND w[-2] = w[-3] AND ends_with({_stem_of(1)}, '#') AND w[-2] NOT IN ('l', 's', 'z') THEN left(w, length(w) - 2)
      WHEN regexp_matches({_stem_of(1)}, {_ONE}) AND NOT regexp_matches({_stem_of(1)}, {_TWO}) AND {_short('left(w, length(w) - 1)', _stem_of(1))} THEN left(w, length(w) - 1) || 'e' ELSE left(w, length(w) - 1) END""",
    f"CASE WHEN ends_with(w, 'y') AND contains({_stem_of(1)}, 'v') THEN left(w, length(w) - 1) || 'i' ELSE w END",
    _endings(STEP2, _ONE),
    _endings(STEP3, _ONE),
    _endings(dict.fromkeys(STEP4, ""), _TWO, "w[-4] IN ('s', 't')"),
    f"""CASE WHEN ends_with(w, 'e') AND (regexp_matches({_stem_of(1)}, {_TWO}) OR regexp_matches({_stem_of(1)}, {_ONE}) AND NOT {_short('left(w, length(w) - 1)', _stem_of(1))}) THEN left(w, length(w) - 1) ELSE w END""",
    f"CASE WHEN ends_with(w, 'll') AND regexp_matches(f, {_TWO}) THEN left(w, length(w) - 1) ELSE w END",
)
_STEMS = (
    "w0 AS (SELECT DISTINCT term, term AS w FROM raw), "
    + ", ".join(f"w{n + 1} AS (SELECT term, CASE WHEN strlen(term) BETWEEN 3 AND 64 THEN {step} ELSE w END AS w FROM (SELECT term, w, {_form('w')} AS f FROM w{n}))" for n, step in enumerate(_STEPS))
    + f", k AS (SELECT blob_hash, w AS term, pos FROM raw JOIN w{len(_STEPS)} USING (term))"
)

_WORDS = [["the"], ["and"], ["that"]]
_KEYWORD = f"{_BLOBS}, {_CONTENTS}, {_TOKENS}, {_counts(_WORDS)}"


def _min_max(value: str, over: str) -> str:
    return f"CASE WHEN max({value}) OVER ({over}) = min({value}) OVER ({over}) THEN 0.5::DOUBLE ELSE ({value} - min({value}) OVER ({over})) / (max({value}) OVER ({over}) - min({value}) OVER ({over})) END"


_PATHS = "paths AS (SELECT blob_hash, string_agg(DISTINCT path, '|' ORDER BY path) AS paths FROM b GROUP BY blob_hash)"


def _fts_only(limit: int, where: str = "true") -> str:
    return f"""
WITH {_KEYWORD}, {_PATHS},
top AS (SELECT * FROM hit ORDER BY bm25, blob_hash LIMIT {limit}),
scored AS (SELECT blob_hash, {_min_max('-bm25', '')} AS score FROM top WHERE {where}),
best AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, blob_hash) AS INTEGER) AS rank FROM scored)
SELECT rank, blob_hash, paths, round(score, 6) AS score, 'FTS' AS provenance, true AS degraded FROM best JOIN paths USING (blob_hash) WHERE rank <= 10"""


def _hybrid(where: str = "true") -> str:
    return f"""
WITH {_KEYWORD}, {_PATHS}, {_QUANTISED}, {_SCORED},
vh AS (SELECT blob_hash, max(score) AS score FROM v JOIN b ON vec_id = doc_id WHERE {where} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50),
kh AS (SELECT * FROM (SELECT * FROM hit ORDER BY bm25, blob_hash LIMIT 50) WHERE {where}),
vn AS (SELECT blob_hash, {_min_max('score', '')} AS x FROM vh),
kn AS (SELECT blob_hash, {_min_max('-bm25', '')} AS y FROM kh),
pool AS (SELECT blob_hash, 0.7::DOUBLE * coalesce(x, 0) + 0.3::DOUBLE * coalesce(y, 0) AS blended FROM vn FULL JOIN kn USING (blob_hash)),
seen AS (SELECT blob_hash, min({_epoch('o_orderdate')}) AS first_seen FROM lineitem JOIN b ON l_partkey = doc_id JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
rel AS (SELECT blob_hash, max(len(list_filter(['the', 'and', 'that', 'src1'], lambda t: contains(lower(path), t))) / 4.0::DOUBLE) AS relevance FROM b GROUP BY 1),
sig AS (
  SELECT blob_hash, blended, relevance,
    CASE WHEN count(first_seen) OVER () <> count(*) OVER () THEN NULL WHEN max(first_seen) OVER () = min(first_seen) OVER () THEN 1::DOUBLE
      ELSE (first_seen - min(first_seen) OVER ()) / (max(first_seen) OVER () - min(first_seen) OVER ())::DOUBLE END AS recent
  FROM pool JOIN rel USING (blob_hash) LEFT JOIN seen USING (blob_hash)),
scored AS (SELECT blob_hash, (0.7::DOUBLE * blended + coalesce(0.2::DOUBLE * recent, 0) + 0.1::DOUBLE * relevance) / (0.8::DOUBLE + CASE WHEN recent IS NULL THEN 0 ELSE 0.2::DOUBLE END) AS score FROM sig),
best AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, blob_hash) AS INTEGER) AS rank FROM scored)
SELECT rank, blob_hash, paths, round(score, 6) AS score, 'HYBRID' AS provenance, false AS degraded FROM best JOIN paths USING (blob_hash) WHERE rank <= 10"""


_ORDERS = f"""
o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN {_epoch('o_orderdate')} END AS seen FROM orders),
s AS (
  SELECT o_orderkey, {_min_max('o_totalprice', 'PARTITION BY o_custkey')} AS score,
    CASE WHEN count(seen) OVER w <> count(*) OVER w THEN NULL WHEN max(seen) OVER w = min(seen) OVER w THEN 1::DOUBLE ELSE (seen - min(seen) OVER w) / (max(seen) OVER w - min(seen) OVER w)::DOUBLE END AS recency,
    len(list_filter(['high', 'urgent'], lambda t: contains(lower(o_orderpriority), t))) / 2.0::DOUBLE AS path
  FROM o WINDOW w AS (PARTITION BY o_custkey))"""

_CASES = """
e AS (SELECT CAST(label AS BIGINT) AS case_id, vec_id, label || '/' || vec_id AS path, embedding[1] AS x, embedding[2] AS y FROM embeddings),
expected AS (SELECT case_id, count(*) FILTER (x > 0) AS wanted FROM e GROUP BY 1),
r AS (SELECT case_id, x > 0 AS relevant, row_number() OVER (PARTITION BY case_id ORDER BY y DESC, vec_id) AS rank FROM e),
j AS (SELECT case_id, count(*) AS retrieved, count(*) FILTER (relevant) AS found, min(CASE WHEN relevant THEN rank END) AS first FROM r WHERE rank <= 10 GROUP BY 1),
m AS (
  SELECT case_id, retrieved, found / retrieved::DOUBLE AS precision, CASE WHEN wanted = 0 THEN 1::DOUBLE ELSE found / wanted::DOUBLE END AS recall,
    coalesce(1 / first::DOUBLE, 0) AS reciprocal_rank, CAST(first AS BIGINT) AS first_relevant_rank FROM expected JOIN j USING (case_id))"""

_COVERAGE = """
known AS (SELECT count(DISTINCT blob_hash) AS known FROM b),
embedded AS (SELECT count(DISTINCT blob_hash) AS embedded FROM b JOIN embeddings ON doc_id = vec_id),
cov AS (SELECT embedded, known, round(CASE WHEN known = 0 THEN 0 ELSE embedded / known::DOUBLE END, 6) AS fraction, known > 0 AND embedded >= known AS complete FROM known, embedded)"""

_NEW = "fresh AS (SELECT DISTINCT blob_hash, content FROM b WHERE blob_hash NOT IN (SELECT blob_hash FROM i))"

ORACLES: dict[str, str] = {
    # registry
    "blob_registry": f"WITH {_BLOBS} SELECT blob_hash, CAST(max({_UNITS.format('content')}) AS BIGINT) AS size, CAST(max({_END_LINE.format('content')}) AS BIGINT) AS end_line, count(*) AS entries FROM b GROUP BY 1",
    "paths_for_blob": f"WITH {_BLOBS}, {_PATHS} SELECT * FROM paths",
    "branches_for": f"WITH {_BLOBS} SELECT blob_hash, string_agg(DISTINCT branch, '|' ORDER BY branch) AS branches FROM b GROUP BY 1",
    "blobs_on_branch": f"WITH {_BLOBS} SELECT DISTINCT blob_hash FROM b WHERE branch = 'src1'",
    "blob_exists_semi": f"WITH {_BLOBS}, {_INDEXED} SELECT doc_id, blob_hash FROM b WHERE EXISTS (SELECT 1 FROM i WHERE i.blob_hash = b.blob_hash)",
    "filter_new_blobs_anti": f"WITH {_BLOBS}, {_INDEXED} SELECT DISTINCT blob_hash FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.blob_hash = b.blob_hash)",
    "insert_or_ignore": f"WITH {_BLOBS}, {_INDEXED} SELECT DISTINCT blob_hash, CASE WHEN blob_hash IN (SELECT blob_hash FROM i) THEN 'present' ELSE 'new' END AS origin FROM b",
    "first_seen": f"SELECT p_partkey AS blob_hash, any_value(p_name) AS path, min({_epoch('o_orderdate')}) AS first_seen FROM part LEFT JOIN (lineitem JOIN orders ON l_orderkey = o_orderkey) ON l_partkey = p_partkey GROUP BY 1",
    "blob_commit_links": "SELECT DISTINCT l_partkey AS blob, l_orderkey AS commit FROM lineitem",
    "embed_config_latest": f"SELECT user_id, event_type, round(value, 6) AS value, {_epoch('ts')} AS updated_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "most_recent_ref": "SELECT user_id AS ref FROM events ORDER BY ts DESC, event_id DESC LIMIT 1",
    "counts": f"WITH {_BLOBS} SELECT count(DISTINCT blob_hash) AS blobs, count(*) AS entries, (SELECT count(*) FROM orders) AS commits FROM b",
    "count_for_model": "SELECT label AS model, count(DISTINCT vec_id // 4) AS blobs FROM embeddings GROUP BY 1",
    "vector_entry_for": f"WITH {_QUANTISED} SELECT vec_id, label, array_to_string(data, ',') AS q_data FROM q WHERE vec_id = 7",
    "content_for": f"WITH {_BLOBS} SELECT DISTINCT blob_hash, content FROM b WHERE blob_hash = (SELECT blob_hash FROM b WHERE doc_id = 0)",
    "last_commit_by_insert": "SELECT o_orderkey AS commit_hash FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1",
    "oversized_tally": "SELECT count(*) FILTER (strlen(text) > 20000) AS oversized, count(*) FILTER (strlen(text) <= 20000) AS fitting FROM documents",
    "index_tally": f"WITH {_BLOBS}, {_INDEXED}, {_NEW}, x AS (SELECT count(*) AS new, count(*) FILTER (strlen(content) > 20000) AS oversized FROM fresh) SELECT (SELECT count(*) FROM b) AS seen, (SELECT count(*) FROM b) - new AS skipped, new - oversized AS indexed, oversized FROM x",
    "git_blob_ids": "SELECT doc_id, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS object_id FROM documents",
    "latest_path_in_window": f"WITH {_BLOBS}, n AS (SELECT *, CAST((row_number() OVER (PARTITION BY branch ORDER BY doc_id) - 1) // 500 AS BIGINT) AS window_no FROM b) SELECT branch, window_no, blob_hash, arg_max(path, doc_id) AS path, count(*) AS entries FROM n GROUP BY ALL",
    # chunks
    "file_chunk_spans": f"SELECT doc_id, CAST(1 AS INTEGER) AS start_line, CAST({_END_LINE.format('text')} AS INTEGER) AS end_line FROM documents",
    "fixed_chunks_1500": _fixed(1500),
    "fixed_chunks_800": _fixed(800),
    "fallback_chain": f"""
WITH RECURSIVE {_BLOBS}, {_CONTENTS}, t AS (SELECT * FROM c WHERE length(content) > 1600), {_spans('1500, 800')},
x AS (SELECT blob_hash, w, count(*) AS chunks, max(n_chars) <= 1600 AS ok FROM s GROUP BY ALL),
y AS (SELECT blob_hash, arg_max(chunks, w) FILTER (ok) AS chunks FROM x GROUP BY 1)
SELECT blob_hash, CAST(0 AS BIGINT) AS chunks, true AS embedded FROM c WHERE length(content) <= 1600
UNION ALL SELECT blob_hash, coalesce(chunks, 0), chunks IS NOT NULL FROM y""",
    # vectors
    "quantized": f"WITH {_QUANTISED} SELECT vec_id, round(CAST(low AS DOUBLE), 6) AS q_min, round(CAST(scale AS DOUBLE), 9) AS q_scale, array_to_string(data, ',') AS q_data FROM q",
    "dequantize_error": f"WITH {_QUANTISED} SELECT vec_id, round(CAST(list_max(list_transform(list_zip(embedding, v), lambda x: abs(x[1] - x[2]))) AS DOUBLE), 6) AS max_error FROM d",
    "vector_topk": _topk("vec_id"),
    "vector_topk_branch": _topk("vec_id", "blob_hash IN (SELECT sha1(CAST(vec_id AS VARCHAR)) FROM embeddings WHERE label = 3)"),
    "vector_topk_chunks": _topk("vec_id // 4"),
    # text
    "path_relevance": f"WITH {_BLOBS} SELECT doc_id, round(len(list_filter(list_filter(regexp_split_to_array(lower('SRC1 en/missing'), '\\W+'), lambda t: t <> ''), lambda t: contains(lower(path), t))) / 3.0::DOUBLE, 6) AS relevance FROM b",
    "quoted_queries": """SELECT item_id, array_to_string(list_transform(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda t: t <> ''), lambda t: '"' || replace(t, '"', '""') || '"'), ' ') AS quoted FROM benchmark""",
    "context_errors": "SELECT conv_id, turn, regexp_matches(text, '(?i)context|input length|too long|exceeds|maximum.*token|token.*limit') AS context_error FROM conversations",
    "fts_match": f"WITH {_KEYWORD} SELECT blob_hash FROM hit",
    "fts_bm25_nostem": f"WITH {_KEYWORD} SELECT blob_hash, round(bm25, 6) AS bm25 FROM hit",
    "fts_phrase": f"WITH {_BLOBS}, {_CONTENTS}, {_TOKENS}, {_counts([['of', 'the'], ['and']])} SELECT blob_hash, round(bm25, 6) AS bm25 FROM hit",
    "fts_porter": f"WITH {_BLOBS}, {_CONTENTS}, {_TOKENS.replace('k AS (SELECT', 'raw AS (SELECT')}, {_STEMS}, {_counts([['ing'], ['of', 'the']])} SELECT blob_hash, round(bm25, 6) AS bm25 FROM hit",
    "fts_vocabulary": f"WITH {_BLOBS}, {_CONTENTS}, {_TOKENS} SELECT term, count(DISTINCT blob_hash) AS docs, count(*) AS occurrences FROM k GROUP BY 1",
    # scores
    "minmax_norm": f"SELECT doc_id, round({_min_max('CAST(n_chars AS DOUBLE)', 'PARTITION BY source')}, 6) AS score FROM documents",
    "hybrid_blend": f"""
WITH v AS (SELECT vec_id % 16 AS query_id, vec_id AS id, {_min_max('CAST(embedding[1] AS DOUBLE)', 'PARTITION BY vec_id % 16')} AS v FROM embeddings),
w AS (SELECT doc_id % 16 AS query_id, doc_id AS id, {_min_max('CAST(n_chars AS DOUBLE)', 'PARTITION BY doc_id % 16')} AS w FROM documents)
SELECT query_id, id, round(0.7::DOUBLE * coalesce(v, 0) + 0.3::DOUBLE * coalesce(w, 0), 6) AS score FROM v FULL JOIN w USING (query_id, id)""",
    "recency": f"WITH {_ORDERS} SELECT o_orderkey, round(recency, 6) AS recency FROM s",
    "three_signal": f"WITH {_ORDERS} SELECT o_orderkey, round((0.7::DOUBLE * score + coalesce(0.2::DOUBLE * recency, 0) + 0.1::DOUBLE * path) / (0.8::DOUBLE + CASE WHEN recency IS NULL THEN 0 ELSE 0.2::DOUBLE END), 6) AS score FROM s",
    # whole searches
    "search_hybrid": _hybrid(),
    "search_hybrid_branch": _hybrid("blob_hash IN (SELECT blob_hash FROM b WHERE branch = 'src1')"),
    "search_fts_only": _fts_only(10),
    "search_fts_only_branch": _fts_only(50, "blob_hash IN (SELECT blob_hash FROM b WHERE branch = 'src1')"),
    "result_lines": f"SELECT rank, concat_ws(chr(9), rank, printf('%.6f', score), 'fts', substr(blob_hash, 1, 12), replace(paths, '|', ', ')) AS line FROM ({_fts_only(10)})",
    "coverage": f"WITH {_BLOBS}, {_COVERAGE} SELECT * FROM cov",
    "status": f"WITH {_BLOBS}, {_COVERAGE} SELECT *, (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_indexed, (SELECT CAST(max(len(embedding)) AS INTEGER) FROM embeddings) AS dimensions FROM cov",
    # evaluation
    "eval_cases": f"WITH {_CASES} SELECT case_id, retrieved, round(precision, 6) AS precision, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, first_relevant_rank FROM m",
    "eval_report": f"WITH {_CASES} SELECT count(*) AS cases, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr FROM m",
    "eval_coverage": """
WITH r AS (SELECT o_custkey AS case_id, count(*) FILTER (o_orderstatus = 'F') AS embedded, count(*) AS known, bool_or(o_orderstatus = 'P') AS degraded FROM orders GROUP BY 1)
SELECT embedded, known, (SELECT bool_or(degraded) FROM r) AS any_degraded FROM r ORDER BY embedded / known::DOUBLE, case_id LIMIT 1""",
    # walks
    "commit_range_walk": """
WITH RECURSIVE tip AS (SELECT max(o_orderkey) AS commit FROM orders),
x AS (SELECT commit FROM tip UNION SELECT o_orderkey // 2 FROM x JOIN orders ON o_orderkey = commit),
y AS (SELECT commit // 16 AS commit FROM tip UNION SELECT o_orderkey // 2 FROM y JOIN orders ON o_orderkey = commit)
SELECT commit FROM x WHERE commit NOT IN (SELECT commit FROM y)""",
    "commit_changes": """
WITH r AS (SELECT DISTINCT l_orderkey AS commit, l_linenumber AS path, l_partkey AS blob FROM lineitem)
SELECT commit, path, blob FROM r WHERE NOT EXISTS (SELECT 1 FROM r p WHERE p.commit + 1 = r.commit AND p.path = r.path AND p.blob = r.blob)""",
}
