"""Every registered query with SQL equals DuckDB on the smallest tables; the entry runs; llm can be taken away."""

from __future__ import annotations

import subprocess
import sys
from functools import lru_cache
from pathlib import Path

import duckdb
import pytest

from frameloom.plans import document_queries, edit_queries, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(smoke_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{smoke_dir}/{t}.parquet')")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_inputs():
    """What many edit and document queries start from is derived once for this module."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(edit_queries, "Fixture", lru_cache(edit_queries.Fixture))
        patch.setattr(document_queries, "detailed", lru_cache(document_queries.detailed))
        yield


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.12g}")
    return value if value is None or isinstance(value, (int, str, bool)) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, smoke_dir, name):
    df = registry.queries()[name](spark, smoke_dir)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(x[0] for x in want.description)
    assert sorted(df.columns) == columns
    order = [[x[0] for x in want.description].index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_entry_and_import_without_a_session(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "frameloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert ".llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
