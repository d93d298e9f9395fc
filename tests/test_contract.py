"""The driver's contract: names, and the registered queries on the smallest tables against their SQL."""
import os

import pytest

D = "/root/testdata/sf0.001"


def test_every_core_query_has_sql():
    from quarrykit.plans.queries import ORACLES, QUERIES

    assert set(ORACLES) == set(QUERIES) and len(QUERIES) > 35


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", ["relevance_top2", "snippet", "save_projection", "class_info_extract", "context_summary"])
def test_query_against_sql(spark, name):
    import duckdb

    from quarrykit.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("class_info", "saved_pattern", "chat_event", "reply", "documents"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    got = QUERIES[name](spark, D)
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))
