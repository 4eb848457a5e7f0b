import duckdb
import pytest

from polynet.operators.features import pair_features, union_rings
from polynet.plans import catalogue, holes, lookups
from tests.test_networks import rows_of
from tests.test_union_rings import LEFT, RIGHT, shapes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [holes.holed_pair_union_shape.__name__, holes.holed_union_rings.__name__, lookups.rule_list_table.__name__])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("customer", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.execute(catalogue.ORACLE_SQL[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(expected.columns) and len(got)
    assert rows_of(got) == rows_of(expected)


def test_pairs_without_a_cell_and_cells_without_a_place(spark):
    pairs, cells = shapes(spark, LEFT, RIGHT)
    missing = spark.createDataFrame([(1, 0, 9), (1, None, 1), (2, 0, 1)], pairs.schema)
    assert union_rings(missing, cells).count() == 0 and pair_features(missing, cells, ("union",)).count() == 0
    lost = cells.withColumn("extra", cells.area).where("polygon_id = 0")
    assert union_rings(pairs, lost).count() == 0
