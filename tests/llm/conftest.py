"""Tables with nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = (
    "h", "c", "at", "fp", "key", "part", "size", "root", "node", "least", "x", "y", "score", "bin", "i", "row", "piece", "shard", "cluster", "salt", "doc", "marks", "spans",
    "_s", "_epochs", "_last", "_copies", "_copy", "_id", "_fp", "_own", "taken", "target", "epochs", "some", "digest", "first", "quality", "held_out", "component_id",
)
WORDS = "the of and to in is that for it was on are as with they at be this from have or by one had not but what all were when we there can an your which their said if do will".split()


def prose(n: int, seed: int) -> str:
    state, out = seed * 7919 + 13, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) & 0x7FFFFFFF
        out.append(WORDS[(state >> 8) % len(WORDS)])
    return " ".join(out)


def edge_rows() -> list[tuple]:
    long = prose(40_000, 3) + " 4111 1111 1111 1111 " + "\n".join(f"key{n} deadbeef{n:020x}" for n in range(2000))
    return [
        (1, prose(60, 1), "en", "b", 1),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, prose(60, 2), "en", None, 4),
        (None, prose(60, 4), "en", "b", 5),
        (5, prose(60, 5), "en", "b", 6),
        (5, prose(60, 5), "en", "b", 6),
        (6, long, "en", "c", len(long)),
        (7, prose(60, 1), "de", "c", 7),
        (8, " \t\n\r ", "de", "c", 5),
        (9, "ÄÖÜ ß 日本 😀 " + prose(30, 9), "de", "d", 9),
        (10, prose(60, 1).upper(), "de", "d", 9),
        (None, None, None, None, None),
    ]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clashing: bool = False):
        rows = [r if len(r) == 5 else (*r, "en", "a", 0) for r in rows]
        df = spark.createDataFrame(rows, SCHEMA)
        return df.withColumns({c: F.lit("clash") for c in CLASHING}) if clashing else df

    return make


@pytest.fixture(scope="session")
def edges(make_docs):
    return make_docs(edge_rows(), clashing=True)


@pytest.fixture(scope="session")
def nothing(make_docs):
    return make_docs([])


@pytest.fixture
def same_in_duckdb(tmp_path):
    """Holds a frame against SQL over the tables that it was made from."""

    def check(result, sql: str, **tables) -> None:
        with duckdb.connect() as con:
            for name, df in tables.items():
                df.coalesce(1).write.parquet(str(tmp_path / name))
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
            wanted = con.execute(sql)
            names = [c[0] for c in wanted.description]
            rows = wanted.fetchall()
        assert sorted(names) == sorted(result.columns)
        shown = lambda rows: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows)
        assert shown(tuple(r) for r in result.select(*names).collect()) == shown(rows)

    return check
