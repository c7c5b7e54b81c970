"""All registered queries against their SQL, and the driver's contract."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from loreseek.operators import fts
from loreseek.plans.oracles import ORACLES
from loreseek.plans.queries import QUERIES

DATA = Path(os.environ.get("TESTDATA", "/root/testdata/sf0.001"))
ROOT = Path(__file__).parent.parent
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test data")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def shown(rows) -> list[str]:
    return sorted(repr([round(x, 6) + 0.0 if isinstance(x, float) and math.isfinite(x) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, tables, name):
    wanted = tables.execute(ORACLES[name])
    names = [c[0] for c in wanted.description]
    found = QUERIES[name](spark, str(DATA))
    assert sorted(found.columns) == sorted(names)
    assert shown(found.select(*names).collect()) == shown(wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_the_others_have_rows(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_searches_push_limits_and_prune_columns(spark):
    plan = QUERIES["vector_topk"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "label" not in plan.split("ReadSchema")[1]
    plan = QUERIES["search_hybrid"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    scored = spark.createDataFrame([(0, "a", 1.0)], "query_id long, blob_hash string, bm25 double")
    assert "WindowGroupLimit" in fts.best(scored, 3)._jdf.queryExecution().executedPlan().toString()
    plan = QUERIES["oversized_tally"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan


def in_a_process(code: str, root: Path) -> str:
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()[-1]


def test_entry_is_imported_without_a_session():
    assert int(in_a_process("import __spark_entry__ as e; print(len(e.queries()))", ROOT)) >= len(QUERIES)


def test_rest_stands_alone(tmp_path):
    """Without the removable part, the driver's module has the engine's own queries."""
    shutil.copytree(ROOT / "loreseek", tmp_path / "loreseek", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, loreseek.cli, loreseek.streaming.follow; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    assert int(in_a_process(code, tmp_path)) == len(QUERIES)
    # A library that only the removable part needs may be missing, too.
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    assert int(in_a_process(code, ROOT)) == len(QUERIES)
    assert not any("loreseek.llm" in p.read_text() for p in (tmp_path / "loreseek").rglob("*.py"))
