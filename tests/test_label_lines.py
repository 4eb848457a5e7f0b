import pytest

from polynet.sources import networks, sinks

PLAIN = "first;second;time\n3,4,7\n\n4 3\n5, 6, soon\n7 only\n8\t9\t-2\nx,1,2"
STRICT = "-1 2 3\n1 2\n2\t1 9\n3 4 x\n5 y 1\n3,4"
MIXED = "file,pair,a,b,seen,time\n# note\na.json,0,3,4,1,12.0\na.json,1,5,6,0,-1\n\"7\" 8\nb.json 9 10 late\nnothing here\n7 8 5"


def issues(spark, tmp_path, text, layout):
    (tmp_path / "s_real_division_pairs.csv").write_text(text)
    return sorted((int(r.detail), r.code) for r in networks.label_issues(spark, str(tmp_path), layout).collect())


def labels(read, spark, tmp_path):
    return sorted((r.first_id, r.second_id, r.division_time) for r in read(spark, str(tmp_path)).collect())


def test_plain_lines(spark, tmp_path):
    found = issues(spark, tmp_path, PLAIN, networks.plain_label_lines)
    assert found == [(5, networks.NO_TIME), (6, networks.NO_IDS), (8, networks.NO_IDS)]
    assert labels(networks.read_labels, spark, tmp_path) == [(3, 4, -1), (5, 6, -1), (8, 9, -2)]


def test_strict_lines(spark, tmp_path):
    found = issues(spark, tmp_path, STRICT, networks.strict_label_lines)
    assert found == [(4, networks.NO_TIME), (5, networks.NO_IDS), (6, networks.NO_IDS)]
    assert labels(networks.read_strict_labels, spark, tmp_path) == [(1, 2, 9)]


def test_mixed_lines(spark, tmp_path):
    found = issues(spark, tmp_path, MIXED, networks.mixed_label_lines)
    assert found == [(6, networks.NO_TIME), (7, networks.NO_IDS)]
    assert labels(networks.read_mixed_labels, spark, tmp_path) == [(3, 4, 12), (7, 8, -1), (9, 10, -1)]


@pytest.mark.parametrize(("by_line", "time"), [(True, 2), (False, 9)])
def test_time_of_a_repeated_label(spark, by_line, time):
    rows = spark.createDataFrame([("s", 0, 1, 9, 0), ("s", 0, 1, 2, 1)], "snapshot_id string, first_id int, second_id int, division_time int, line int")
    features = spark.createDataFrame([("s", 0, 1, 0.5)], "snapshot_id string, first_id int, second_id int, areaRatio double")
    assert sinks.pair_geometry_table(features, rows if by_line else rows.drop("line")).first().division_timing == time


def test_query_equals_sql(spark):
    import duckdb

    from polynet.plans import catalogue, lookups  # noqa: F401 (registers its queries)
    from tests.test_networks import SF, TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["label_lines"])
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in names]
    rows = sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())
    assert sorted(str(tuple(r)) for r in catalogue.QUERIES["label_lines"](spark, SF).select(names).collect()) == rows
