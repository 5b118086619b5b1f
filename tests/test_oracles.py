"""Every query with SQL against DuckDB on the sample tables; the others give rows."""

import math

import duckdb
import pytest

from tapespark import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(table, names):
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[n]) for n in names) for r in table.to_pylist()), key=lambda r: tuple(map(str, r)))


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    got = catalogue.queries()[name](spark, SF).toArrow()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
        return
    want = con.execute(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    kind = lambda t, n: str(t.schema.field(n).type).replace("large_", "")
    assert {n: kind(got, n) for n in got.column_names} == {n: kind(want, n) for n in got.column_names}
    assert rows(got, want.column_names) == rows(want, want.column_names)
