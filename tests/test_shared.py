"""The shared folder and its tables."""

from __future__ import annotations

import pyarrow as pa
import pytest

from loreseek.sources import shared


class Elsewhere:
    """A session of another cluster, without a shared folder."""

    class conf:
        get = staticmethod(lambda name, default: default)

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_must_name_its_folder(monkeypatch):
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared.shared_dir(Elsewhere)
    monkeypatch.setattr(Elsewhere.sparkContext, "master", "local[8]")
    assert shared.shared_dir(Elsewhere).startswith("file:///")


def test_tables_are_written_below_it_and_removed(spark, monkeypatch):
    monkeypatch.setattr(shared, "_written", [])
    scratch = shared.Scratch(spark, "test")
    assert scratch.path.startswith(spark.conf.get("spark.checkpoint.dir"))
    table = scratch.table(spark.range(5).repartition(3), "five")
    assert table.count() == 5 and spark.conf.get(shared._CLEANUP) == "false"
    assert shared.clean(spark) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        scratch.read("five").count()


def test_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 20000) AS t")
    shared.bound_batches(spark)
    found = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 3000 and max(found) < 500
