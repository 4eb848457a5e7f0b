"""Cells with three corners on a line: hulls of the queries and of their SQL."""

import duckdb
import pytest

from polynet.plans import catalogue, grown, holes  # noqa: F401
from tests.test_networks import rows_of

NAMES = ["single_cells", "pair_stats", "grown_pair_stats", "grown_pair_union_shape", "holed_pair_union_shape"]


@pytest.fixture(scope="module")
def regular(tmp_path_factory):
    """Customers and parts whose walls have straight rows of corners."""
    folder, con = tmp_path_factory.mktemp("regular"), duckdb.connect()
    con.execute(f"COPY (SELECT i AS c_custkey, 10.5::DOUBLE AS c_acctbal FROM range(150) r(i)) TO '{folder}/customer.parquet'")
    con.execute(f"COPY (SELECT i AS p_partkey, 3.25::DOUBLE AS p_retailprice FROM range(200) r(i)) TO '{folder}/part.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_on_straight_sides(spark, regular, name):
    con = duckdb.connect()
    for table in ("customer", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{regular}/{table}.parquet'")
    expected = con.execute(catalogue.ORACLE_SQL[name]).df()
    got = catalogue.QUERIES[name](spark, regular).toPandas()
    assert sorted(got.columns) == sorted(expected.columns) and len(got)
    assert rows_of(got) == rows_of(expected)
    if name == "single_cells":
        assert (expected.solidity == 1).all()
