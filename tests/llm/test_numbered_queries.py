"""The numbered queries on the smallest tables: columns as given, and SQL where there is some."""
import os

import pytest

from quarrykit.llm.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": "tag_a string, tag_b string", "p2_found": "seq_a bigint, seq_b bigint", "p2_groups": "seq bigint, group bigint, links bigint", "p3_found": "pos int", "p4_found": "field string, term string, mark string",
    "p5_found": "tab string, row_key bigint, line_no int", "p6_ids": "doc_id bigint, ids array<int>", "p8_found": "doc_id_a bigint, doc_id_b bigint",
}


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, D)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(map(repr, rows)))
    if name in ORACLES:
        import duckdb

        con = duckdb.connect()
        con.sql(f"create view saved_pattern as select * from '{D}/saved_pattern.parquet'")
        want = con.sql("select " + ", ".join(f'"{c}"' for c in df.columns) + f" from ({ORACLES[name]})").fetchall()
        assert sorted(map(repr, rows)) == sorted(map(repr, want))
