"""The registered queries of the training-data operators: contract columns, a row for each row of the table, and their SQL."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from loreseek.llm.queries import ORACLES, QUERIES

DATA = Path(os.environ.get("TESTDATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test data")

#: The contracts' columns and Spark types, and the table whose rows are returned once each (None: another number).
CONTRACTS = {
    "op1_best_fit_packing": ({"doc_id": "bigint", "bin": "bigint", "shard": "int"}, None),
    "op2_quality_classifier": ({"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}, "documents"),
    "op3_mix_to_target_weights": ({"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}, "documents"),
    "op4_simhash_near_dedup": ({"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}, "documents"),
    "op5_secret_scan": ({"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}, "documents"),
    "op6_telephony_audio": ({"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}, "documents"),
    "op7_warc_capture_index": ({"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}, "pages"),
    "op8_suffix_array_dedup": ({"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}, "documents"),
    "op9_exact_top_k": ({"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}, None),
    "op10_personal_data": ({"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"}, "documents"),
}


def shown(rows) -> list[str]:
    return sorted(repr([round(x, 6) + 0.0 if isinstance(x, float) and math.isfinite(x) else x for x in r]) for r in rows)


def test_all_ten_are_registered():
    assert set(QUERIES) == set(CONTRACTS) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract(spark, name):
    columns, table = CONTRACTS[name]
    found = QUERIES[name](spark, str(DATA))
    assert {c: t for c, t in found.dtypes if c in columns} == columns
    rows = found.collect()
    with duckdb.connect() as con:
        for p in DATA.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        if table:
            key = "page_id" if table == "pages" else "doc_id"
            assert sorted(r[key] for r in rows) == [k for (k,) in con.execute(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()]
        else:
            assert rows
        if name in ORACLES:
            wanted = con.execute(ORACLES[name])
            names = [c[0] for c in wanted.description]
            assert sorted(names) == sorted(found.columns) and shown(tuple(r[c] for c in names) for r in rows) == shown(wanted.fetchall())
