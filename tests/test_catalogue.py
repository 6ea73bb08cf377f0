"""Some queries against their SQL on the smallest tables; the driver compares all."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
NAMES = ["pagerank_topk", "graph_summary", "pagerank_dangling", "ppr_topk", "bfs_hops", "url_signals", "robots_verdict", "ranking_quality", "exp10_head_to_head", "score_structure"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def same(value):
    return round(value, 8) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    got = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(frame.columns) == sorted(columns)
    key = lambda rows: sorted(repr(tuple(map(same, r))) for r in rows)
    assert key(frame.select(*columns).collect()) == key(got.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_all_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
