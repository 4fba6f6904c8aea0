"""Edits of a source with so many pages that the numbers of its edits meet: the queries equal their SQL."""

from __future__ import annotations

from functools import lru_cache

import duckdb
import pytest

from frameloom.plans import edit_queries, registry

#: Pages of the long source; the replace of its page 990 has the number of another one, 1000.
PAGES = 1010


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with two frames a page, black and white by turns: source 1 with ``PAGES`` pages, source 3, which the SQL of deletes always names, with ten."""
    folder = tmp_path_factory.mktemp("many")
    frames = f"SELECT 1 AS label, i FROM range({2 * PAGES}) t(i) UNION ALL SELECT 3, i FROM range(20) t(i)"
    duckdb.sql(f"COPY (SELECT 10000 * label + i AS vec_id, CAST(label AS INT) AS label, list_transform(range(64), lambda x: CAST(CASE WHEN i // 2 % 2 = 0 THEN -0.5 ELSE 0.5 END AS FLOAT)) AS embedding FROM ({frames})) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(edit_queries, "Fixture", lru_cache(edit_queries.Fixture))
        yield str(folder)


def equals_its_sql(spark, folder: str, name: str) -> list[dict]:
    """The rows of a query, once they are found to be those of its SQL."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    got = registry.queries()[name](spark, folder)
    told = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    rows = got.collect()
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(told, key=repr)
    return [r.asDict() for r in rows]


def test_outcomes_of_two_replaces_of_one_number(spark, many):
    rows = equals_its_sql(spark, many, "e02_replace_outcomes")
    assert [(r["status"], r["code"]) for r in rows if r["source_id"] == "1" and r["seq"] == 1000] == [("rejected", "DuplicateSample")] * 2
    assert sum(r["status"] == "changed" for r in rows) > 100


def test_pages_of_two_replaces_of_one_number(spark, many):
    rows = sorted((r for r in equals_its_sql(spark, many, "e02_replace_pages") if r["source_id"] == "1"), key=lambda r: r["ticks"])
    assert len(rows) == PAGES and rows[989]["last_edit"] is None and rows[980]["last_edit"] == "replace"


def test_outcomes_of_a_log_hold_its_own_replaces_alone(spark, many):
    rows = equals_its_sql(spark, many, "e06_replay_outcomes")
    assert [r["seq"] for r in sorted(rows, key=lambda r: r["seq"]) if r["source_id"] == "1" and r["seq"] >= 1000] == [1000, 1001, 1002, 1003]


def test_pages_of_a_log_are_moved_by_its_own_replaces_alone(spark, many):
    rows = equals_its_sql(spark, many, "e06_replay_pages")
    assert sum(r["last_edit"] == "replace" for r in rows if r["source_id"] == "1") == 1


def test_live_edits_are_the_log_without_merges(spark, many):
    rows = equals_its_sql(spark, many, "t06_live_edits")
    assert [r["code"] for r in rows if r["code"] == "OutOfOrder"] == []
