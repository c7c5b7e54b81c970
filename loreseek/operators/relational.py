"""The registry's statements as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreseek.sources.store import new_rows


def insert_or_ignore(present: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``present`` and the first row of each new key."""
    return present.unionByName(new_rows(rows.dropDuplicates(keys), present, keys))


def latest(rows: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """The row of each key that was written last."""
    newest = Window.partitionBy(*keys).orderBy(by.desc())
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def paths_for(path_entry: DataFrame) -> DataFrame:
    """(blob_hash, paths): sorted, distinct."""
    return path_entry.groupBy("blob_hash").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def branches_for(blob_branch: DataFrame) -> DataFrame:
    return blob_branch.groupBy("blob_hash").agg(F.sort_array(F.collect_set("branch")).alias("branches"))


def on_branch(blob_branch: DataFrame, branch: str) -> DataFrame:
    """The blobs of a branch, for a semi-join."""
    return blob_branch.filter(F.col("branch") == branch).select("blob_hash").distinct()


def exists_in(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return rows.join(present.select(key), key, "left_semi")


def filter_new(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Each key that is not present, once."""
    return new_rows(rows.dropDuplicates([key]), present, [key])


def first_seen(blob_commit: DataFrame, commits: DataFrame) -> DataFrame:
    """(blob_hash, first_seen): the least time of a blob's commits. The links move once; commits meet them by hash."""
    return blob_commit.join(commits.select("commit_hash", "timestamp"), "commit_hash").groupBy("blob_hash").agg(F.min("timestamp").alias("first_seen"))


def most_recent(rows: DataFrame, what: str, by: str) -> DataFrame:
    return rows.agg(F.max_by(what, by).alias(what))


def entry_for(rows: DataFrame, **keys) -> DataFrame:
    """The rows of one key, null keys included; the comparisons are pushed to the scan."""
    for name, value in keys.items():
        rows = rows.filter(F.col(name).isNull() if value is None else F.col(name) == value)
    return rows


def last_by_insert(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """(key) of the row that was inserted last: one aggregate with map-side combine, no sort."""
    return rows.agg(F.max_by(key, F.struct(*order)).alias(key))


def count_for_model(vectors: DataFrame) -> DataFrame:
    """(model, blobs): distinct blobs, not rows."""
    return vectors.groupBy("model").agg(F.countDistinct("blob_hash").alias("blobs"))
