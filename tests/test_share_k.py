import itertools
import random

import duckdb

from polynet.operators.adjacency import LISTED, share_k_pairs
from polynet.plans import catalogue
from tests.test_networks import rows_of

SF = "/root/testdata/sf0.001"


def test_a_member_of_all_owners_pairs_nobody_by_itself(spark):
    """200,000 owners of one member would be 20 billion pairs."""
    owners = spark.range(200_000).selectExpr("id as o", "explode(array(-1, id div 2 * 2 + id % 2 * (id % 1000 div 999))) as m")
    got = {tuple(r) for r in share_k_pairs(owners, [], "o", "m", 2).collect()}
    sets = {}
    for i in range(200_000):
        sets.setdefault(i // 2 * 2 + i % 2 * (i % 1000 // 999), []).append(i)
    assert got == {(a, b, 2) for s in sets.values() for a, b in itertools.combinations(s, 2)}


def test_large_and_small_owners_equal_all_pairs(spark):
    rng = random.Random(6)
    sets = {(g, o): set(rng.sample(range(200), LISTED + 20 if o < 4 else rng.randrange(1, 12))) for g in "ab" for o in range(30)}
    rows = [(g, o, m) for (g, o), s in sets.items() for m in s] * 2 + [(None, 1, 1), (None, 2, 1)]
    frame = spark.createDataFrame(rows, "g string, o int, m int")
    for k in (1, 2, 3):
        want = {(g, a, b, len(sets[g, a] & sets[g, b])) for g in "ab" for a, b in itertools.combinations(range(30), 2) if len(sets[g, a] & sets[g, b]) >= k}
        assert {tuple(r) for r in share_k_pairs(frame, ["g"], "o", "m", k).collect()} == want


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    expected = con.execute(catalogue.ORACLE_SQL["share_k_members"]).df()
    assert rows_of(catalogue.QUERIES["share_k_members"](spark, SF).toPandas()) == rows_of(expected)
