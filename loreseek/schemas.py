"""The tables of an index, and the rows that its operators return."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


#: name -> (DDL, key columns, partition columns). Keys hold under "ignore" (first row wins) or "replace" (last row wins).
TABLES: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "blob_entry": ("blob_hash string, size long, indexed_at long", ("blob_hash",), ()),
    "path_entry": ("blob_hash string, path string", ("blob_hash", "path"), ()),
    "commit_entry": ("commit_hash string, timestamp long, author_name string, author_email string, message string", ("commit_hash",), ()),
    "blob_commit_entry": ("blob_hash string, commit_hash string", ("blob_hash", "commit_hash"), ()),
    "indexed_commit_entry": ("commit_hash string, indexed_at long", ("commit_hash",), ()),
    "blob_branch_entry": ("blob_hash string, branch string", ("blob_hash", "branch"), ("branch",)),
    "embed_config_entry": ("model string, provider string, dimensions int, chunker string, last_used_at long", ("model",), ()),
    "resume_cursor": ("ref string, model string, commit_hash string, updated_at long", ("ref", "model"), ()),
    "vector_entry": ("blob_hash string, model string, chunk_index int, q_min float, q_scale float, q_data array<tinyint>", ("blob_hash", "model", "chunk_index"), ("model",)),
    "blob_content": ("blob_hash string, content string", ("blob_hash",), ()),
    "fts_postings": ("term string, blob_hash string, tf int, positions array<int>", ("term", "blob_hash"), ()),
    "fts_doc_len": ("blob_hash string, dl int", ("blob_hash",), ()),
}

#: A row that stands for "no chunk": the whole file.
WHOLE_FILE = -1

COMMITS = "hash string, timestamp long, author_name string, author_email string, message string, changed_blobs array<struct<path:string,blob_hash:string>>"
BLOBS = "path string, blob_hash string, walk_order long"
CHUNKS = "array<struct<content:string,start_line:int,end_line:int,strategy:string,symbol:string>>"
MATCHES = "rank int, blob_hash string, paths array<string>, start_line int, end_line int, score double, provenance string, degraded boolean"
EVAL_CASES = "query string, expected_paths array<string>"
