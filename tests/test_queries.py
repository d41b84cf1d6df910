"""Every registered query with SQL gives that SQL's rows; skipped where the test tables are absent."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from frameledger.operators import common
from frameledger.plans import layouts

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in entry.oracle_sql():
        assert len(set(got)) == len(got)
        return
    cur = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


def test_layouts_are_written_to_the_shared_folder(spark):
    root = layouts._root(spark)
    shared = common.shared_folder(spark)
    assert os.path.isabs(root)
    assert "file:" not in root
    assert os.path.dirname(root) == shared.removeprefix("file:")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
