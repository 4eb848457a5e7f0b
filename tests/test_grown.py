import duckdb
import pytest

from polynet.plans import catalogue, grown
from polynet.sources.mesh import customer_mesh
from tests.test_networks import rows_of

SF = "/root/testdata/sf0.001"
NAMES = [n for n in catalogue.QUERIES if n.startswith("grown_") and n in catalogue.ORACLE_SQL]


def test_snapshots_grow_with_the_table(spark):
    assert grown.__name__ and len(NAMES) == 10
    for sf, customers in (("sf0.001", 150), ("sf0.01", 1500)):
        net = customer_mesh(spark, f"/root/testdata/{sf}")
        assert net.vertices.count() == customers
        assert net.polygons.select("snapshot_id").distinct().count() == -(-customers // 117)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    expected = con.execute(catalogue.ORACLE_SQL[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(expected.columns) and len(got)
    assert rows_of(got) == rows_of(expected)
