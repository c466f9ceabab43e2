from pathlib import Path

import duckdb
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    in_order = ", ".join(columns)
    key = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert key(got.select(*columns).collect()) == key(con.sql(f"select {in_order} from want").fetchall())


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
