import os

import duckdb
import pytest

from corpuslane.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs(spark, name):
    df = Q.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in Q.ORACLE:
        con = duckdb.connect()
        for t in ("paper_records", "sample_targets"):
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        assert sorted(got) == sorted(con.execute(Q.ORACLE[name]).fetchall())
