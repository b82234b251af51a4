import duckdb
import pytest

from gridloom.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    want = db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda rs: sorted((tuple(r) for r in rs), key=repr)
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name, txns", [("snapshot_horizon", 3), ("rollback_view", 2), ("multi_segment_txn", 1), ("reopen_database", 3), ("compacted_database", 3)])
def test_paths_are_taken_on_a_small_table(spark, monkeypatch, name, txns):
    from gridloom.plans import catalogue

    made, database = [], catalogue.database
    monkeypatch.setattr(catalogue, "database", lambda *a: made.append(database(*a)) or made[-1])
    QUERIES[name](spark, DATA)
    assert made[0].next_txn == txns + 1
    if name == "multi_segment_txn":
        assert made[0].commits[1]["segments"] == [0, 1, 2]
