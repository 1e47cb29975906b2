import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from palimpsest.session import session

    s = session("tests", spark__master="local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


def same(df, sql, sf=SF):
    """Whether a DataFrame and DuckDB agree, whatever the order."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    want = con.sql(sql)
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = want.select(", ".join(f'"{c}"' for c in cols)).fetchall()
    return got == sorted((tuple(r) for r in rel), key=repr)
