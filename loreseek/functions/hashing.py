"""Content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def git_blob_hash(content: Column) -> Column:
    """The object id that git gives a file with this text (UTF-8)."""
    data = F.encode(content, "UTF-8")
    header = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.char(F.lit(0))), "UTF-8")
    return F.sha1(F.concat(header, data))


def utf16_length(content: Column) -> Column:
    """Length in UTF-16 units; Spark's length() counts code points."""
    return (F.octet_length(F.encode(content, "UTF-16BE")) / 2).cast("int")
