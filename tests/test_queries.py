"""Every query that has SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from marketloom.plans import charts, indicators, learning, lists, memory, parsed, records, relational, reports, stored

DATA = "/root/testdata/sf0.001"
QUERIES = indicators.QUERIES | lists.QUERIES | records.QUERIES | relational.QUERIES | reports.QUERIES | charts.QUERIES | memory.QUERIES | learning.QUERIES | stored.QUERIES | parsed.QUERIES
ORACLES = indicators.ORACLES | lists.ORACLES | records.ORACLES | relational.ORACLES | reports.ORACLES | charts.ORACLES | memory.ORACLES | learning.ORACLES | stored.ORACLES | parsed.ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        path = f"{DATA}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = ordered(tuple(r) for r in df.select(*columns).collect())
    sql = ORACLES[name].strip()
    want = ordered(duck.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({sql}) q").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
