"""Text: path relevance, query phrases, tokens, formatting, and errors of embedding endpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Fixed value: what endpoints say where an input is too long for the model.
TOO_LONG = r"(?i)context|input length|too long|exceeds|maximum.*token|token.*limit"


def path_relevance(query: Column, path: Column) -> Column:
    """The share of the query's tokens (split at what is no ASCII word character) that the lower-case path holds; 0 without tokens."""
    tokens = F.filter(F.split(F.lower(query), r"\W+"), lambda t: t != "")
    hits = F.size(F.filter(tokens, lambda t: F.contains(F.lower(path), t)))
    return F.when(F.size(tokens) > 0, hits / F.size(tokens)).otherwise(F.lit(0.0))


def best_path_relevance(query: Column, paths: Column) -> Column:
    """The highest relevance of several paths; 0 without any."""
    return F.coalesce(F.array_max(F.transform(paths, lambda p: path_relevance(query, p))), F.lit(0.0))


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all non-ASCII characters; only ASCII letters are lower-cased."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _BREAK), lambda t: t != "")


def query_phrases(text: Column) -> Column:
    """The white-space separated parts of a query: each is a phrase, and all must occur."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")


def quoted_query(text: Column) -> Column:
    """The phrases as one string, each in double quotes, inner quotes doubled."""
    return F.array_join(F.transform(query_phrases(text), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " ")


def end_line(text: Column) -> Column:
    """The last line of a whole-file chunk: line feeds plus one."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def is_context_error(message: Column) -> Column:
    return message.rlike(TOO_LONG)


def result_line(rank: Column, score: Column, paths: Column, provenance: Column, blob_hash: Column) -> Column:
    """One tab-separated line: rank, score, kind of search, the first twelve digits of the hash, and the paths if there are any."""
    return F.concat_ws("\t", rank.cast("string"), F.format_string("%.6f", score), F.lower(provenance), F.substring(blob_hash, 1, 12), F.when(paths != "", paths))
