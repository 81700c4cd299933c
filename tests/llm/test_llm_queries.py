"""All queries of this folder on the smallest tables; those with SQL against it."""

import glob
import os

import duckdb
import pytest

from parchmill.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")

#: The columns that the statement of each problem names.
COLUMNS = {
    "p1_found": "tbl string, rec_a bigint, rec_b bigint", "p2_found": "chunk_a bigint, chunk_b bigint", "p3_found": "page_id bigint, line_no int, kind string", "p4_found": "chunk_uid bigint",
    "p5_found": "chunk_uid bigint, sent_end int", "p6_found": "tbl string, rec_id bigint, lang string", "p7_ids": "doc_id bigint, ids array<int>", "p8_found": "doc_id bigint, item_id bigint", "p9_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs_once_per_row(spark, name):
    df = Q.queries()[name](spark, DATA)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = [str(r) for r in df.collect()]
    assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert sorted(map(tuple, Q.queries()[name](spark, DATA).collect())) == sorted(con.execute(Q.oracle_sql()[name]).fetchall())
