"""The folder that driver and executors share, and the tables that an application writes there to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = 8 << 20  # bytes of a batch for a Python worker

_local: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, which only a local master can share with its tasks."""
    global _local
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local($|[\[-])", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _local is None:
        _local = "file://" + tempfile.mkdtemp(prefix="loreseek-shared-")
    return _local


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """While a table is written: its shuffle files go with the write, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def bound_batches(spark: SparkSession) -> None:
    """Bounds batches for Python workers in bytes, not in rows alone, where the session has no bound of its own.

    This stays set, as results are computed when their caller reads them.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH))


class Scratch:
    """A folder of written tables below the shared folder.

    Written tables cut lineage: after the write, a lost executor costs no
    recomputation. ``drop`` removes a table that no later step reads; what
    results still read belongs to the application, see ``clean``.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        bound_batches(spark)
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if not _written:
            atexit.register(_at_exit)
        _written.append((spark, self.path))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a frame and reads it back."""
        schema = df.schema
        with writing(self.spark):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.read(name, schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        remove(self.spark, f"{self.path}/{name}")


def clean(spark: SparkSession) -> int:
    """Removes all scratch tables of this application, whose results must not be read any more; returns how many folders there were."""
    many = len(_written)
    for _, path in _written:
        remove(spark, path)
    _written.clear()
    return many


def _at_exit() -> None:
    """The application's tables end with it. A session that was stopped before leaves them to the owner of the shared folder."""
    with contextlib.suppress(Exception):
        if _written and _written[0][0].sparkContext._jsc is not None:
            clean(_written[0][0])
