"""Every query of the catalogue that has SQL, on the smallest tables."""

import pytest

from tests.conftest import SF
from treeglyph import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, against_sql, name):
    against_sql(queries.QUERIES[name](spark, SF), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_lengths_beyond_those_of_the_sql(spark, tmp_path):
    """Where patterns of over 14 values qualify, lengths_to_256 has them all: the same SQL with more lengths tells, and up to 14 the query's own SQL."""
    import random

    import duckdb

    from treeglyph import sql as Q

    con, shape = duckdb.connect(), random.Random(1).sample(range(20), 20)
    values = ", ".join(f"({20 * rep + i}, {v * 3.0 + rep})" for rep in range(3) for i, v in enumerate(shape))  # one shape three times, all values distinct
    con.sql(f"create table lineitem as select * from '{SF}/lineitem.parquet'")
    con.sql(f"insert into lineitem select l.* replace (1000000 + p.i as l_orderkey, 777777 as l_suppkey, p.v as l_extendedprice) from (select * from lineitem limit 1) l, (values {values}) p(i, v)")
    con.sql(f"copy lineitem to '{tmp_path}/lineitem.parquet'")
    got = {tuple(r) for r in queries.QUERIES["lengths_to_256"](spark, str(tmp_path)).select("rank", "code", "length", "support", "qualifying_series").collect()}
    assert got == set(con.execute(Q.best("suppliers", list(range(2, 25)), 0, 3) + Q.DICTIONARY).fetchall())
    assert max(r[2] for r in got) == 20
    assert {r[1:] for r in got if r[2] <= 14} == {r[1:] for r in con.execute(queries.SQL["lengths_to_256"]).fetchall()}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["rank", "code", "length", "support", "qualifying_series"]
    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
