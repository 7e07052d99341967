"""Every own query against its SQL, and the rules about the package."""

import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from factloom.plans.queries import QUERIES
from factloom.plans.sql import _RANKED, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    return repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    want = db.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in got.collect())
    assert rows == sorted([plain(v) for v in r] for r in want[columns].astype(object).itertuples(index=False))


def test_queries_without_sql_run(spark, sf):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, sf).count() > 0, name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_llm_folder():
    for p in (ROOT / "factloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"factloom\.llm|from factloom import llm", p.read_text()), p


def test_disputed_edges_of_all_documents(spark, sf):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = db.sql(f"WITH {_RANKED} SELECT fact_id_a, fact_id_b FROM edges WHERE type = 'contradicts'").fetchall()
    got = [tuple(r) for r in QUERIES["disputed_edges_all"](spark, sf).collect()]
    assert sorted(got) == sorted(want)
    assert any(a % 20 >= 10 or b % 20 >= 10 for a, b in got)
