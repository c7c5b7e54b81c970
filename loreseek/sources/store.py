"""An index as Parquet tables below a folder.

Writes append. "Ignore" tables drop keys that are there already (an anti-join
against the key columns only); "replace" tables keep all versions and are read
with the latest one. A write is one commit of Spark's file committer, so a
failed job leaves no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreseek.schemas import TABLES, _schema

REPLACE = {"embed_config_entry", "resume_cursor", "blob_content", "fts_postings", "fts_doc_len"}
_SEQ = "_seq"


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def exists(self, table: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(table))
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return files.exists(at) and len(files.listStatus(at)) > 0

    def raw(self, table: str) -> DataFrame:
        schema = _schema(TABLES[table][0])
        schema = schema.add(_SEQ, "long") if table in REPLACE else schema
        if not self.exists(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._at(table))

    def read(self, table: str) -> DataFrame:
        """The rows of a table; of "replace" tables the latest of each key (of a document's postings, all of the latest version)."""
        rows = self.raw(table)
        if table not in REPLACE:
            return rows
        keys = ["blob_hash"] if table.startswith("fts_") or table == "blob_content" else list(TABLES[table][1])
        latest = rows.withColumn("_last", F.max(_SEQ).over(Window.partitionBy(*keys)))
        return latest.filter(F.col(_SEQ) == F.col("_last")).drop("_last", _SEQ)

    def _append(self, table: str, rows: DataFrame) -> None:
        _, _, parts = TABLES[table]
        writer = rows.write.mode("append")
        (writer.partitionBy(*parts) if parts else writer).parquet(self._at(table))

    def insert_or_ignore(self, table: str, rows: DataFrame) -> None:
        """Adds rows whose key is new; of several new rows with one key, one stays."""
        ddl, keys, _ = TABLES[table]
        rows = rows.select(*_schema(ddl).fieldNames()).dropDuplicates(list(keys))
        if self.exists(table):
            rows = new_rows(rows, self.raw(table), list(keys))
        self._append(table, rows)

    def replace(self, table: str, rows: DataFrame, seq: int) -> None:
        """Adds a version of each key; ``seq`` orders the versions."""
        ddl, keys, _ = TABLES[table]
        self._append(table, rows.select(*_schema(ddl).fieldNames(), F.lit(seq).cast("long").alias(_SEQ)).dropDuplicates(list(keys)))

    def next_seq(self) -> int:
        """One more than the number of any version."""
        found = [self.raw(t).agg(F.max(_SEQ)).first()[0] for t in sorted(REPLACE) if self.exists(t)]
        return max([x for x in found if x is not None], default=0) + 1


def new_rows(rows: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not present."""
    return rows.join(present.select(*keys).distinct(), keys, "left_anti")
