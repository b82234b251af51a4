import os
import random

import pytest

from gridloom.database import ArrayDatabase
from gridloom.errors import DataError, EngineError, IoError, SchemaError
from gridloom.schema import ArraySchema

XY = ArraySchema([("x", 1000), ("y", 1000)], ["value"])
GRID = ArraySchema([("time", 50), ("sensor_id", 10)], ["value"])


def rows(txn, **kw):
    return [tuple(r) for r in txn.query(**kw).collect()]


def test_grid_before_and_after_commit_and_again(spark, place):
    for _ in range(2):
        db = ArrayDatabase.open_or_create(spark, place, GRID)
        txn = db.transaction()
        for start in range(0, 100, 25):
            txn.add_rows((i, j, i * 1000 + j) for i in range(start, start + 25) for j in range(100))
            txn.flush()
        assert txn.count() == 10_000
        txn.commit()
        with db.transaction() as after:
            found = rows(after)
        assert found == [(i, j, i * 1000 + j) for i in range(100) for j in range(100)]


def test_newest_wins_across_transactions_and_flushes(spark, place):
    db = ArrayDatabase.create(spark, place, XY)
    with db.transaction() as txn:
        txn.add_rows([(4, 4, 0), (5, 5, 1)])
        txn.commit()
    with db.transaction() as txn:
        txn.add_row((5, 5, 2))
        assert rows(txn) == [(4, 4, 0), (5, 5, 2)]
        txn.flush()
        txn.add_row((5, 5, 3))
        txn.add_row((5, 5, 4))
        assert rows(txn, with_txn=True) == [(4, 4, 0, 1), (5, 5, 4, 4294967295)]
        txn.commit()
    with db.transaction() as txn:
        assert rows(txn, with_txn=True) == [(4, 4, 0, 1), (5, 5, 4, 2)]


def test_rollback_snapshot_and_time_travel(spark, place):
    db = ArrayDatabase.create(spark, place, XY)
    for v in (1, 2, 3):
        with db.transaction() as txn:
            txn.add_row((v, 0, v))
            txn.commit()
    with db.transaction() as txn:
        txn.add_row((9, 9, 9))
        txn.flush()
    with db.transaction() as txn:
        assert [r[0] for r in rows(txn)] == [1, 2, 3]
    assert [r[0] for r in rows(db.transaction(horizon=2))] == [1]
    db.open_transaction = None
    assert [r[0] for r in rows(db.as_of(2))] == [1, 2]


def test_reopen_removes_orphans_and_counts_their_ids(spark, place):
    db = ArrayDatabase.create(spark, place, XY)
    with db.transaction() as txn:
        txn.add_row((1, 1, 1))
        txn.commit()
    txn = db.transaction()
    txn.add_row((2, 2, 2))
    txn.flush()
    base = place.removeprefix("file://")
    with open(f"{base}/_commits/00000005.json", "w") as f:
        f.write('{"txn": 5, "seg')
    again = ArrayDatabase.open(spark, place)  # within the lease nothing goes, and no id is used again
    assert sorted(os.listdir(f"{base}/data")) == ["txn=1", "txn=2"] and again.next_txn == 6
    again = ArrayDatabase.open(spark, place, lease_s=0)
    assert sorted(os.listdir(f"{base}/data")) == ["txn=1"] and [x for x in os.listdir(f"{base}/_commits") if x[0] != "."] == ["00000001.json"] and again.next_txn == 6
    with again.transaction() as t:
        assert rows(t) == [(1, 1, 1)]


def test_read_only_commit_and_empty_flush_use_no_id(spark, place):
    db = ArrayDatabase.create(spark, place, XY)
    with db.transaction() as txn:
        txn.add_rows([])
        txn.flush()
        assert rows(txn) == []
        txn.commit()
    assert db.next_txn == 1 and db.commits == {}


def test_two_writers_of_one_id(spark, place):
    a = ArrayDatabase.create(spark, place, XY)
    b = ArrayDatabase.open(spark, place)
    for n, db in enumerate((a, b)):
        txn = db.transaction()
        txn.segments, txn.txn = [n], 1
        if n == 0:
            txn.commit()
        else:
            with pytest.raises(IoError):
                txn.commit()


def test_losing_writer_leaves_the_winners_rows(spark, place):
    a = ArrayDatabase.create(spark, place, XY)
    b = ArrayDatabase.open(spark, place)
    with a.transaction() as txn:
        txn.add_row((1, 1, 1))
        txn.commit()
    with pytest.raises(IoError), b.transaction() as txn:
        txn.add_row((2, 2, 2))
        txn.flush()
        assert rows(txn) == [(2, 2, 2)]
        txn.commit()
    assert len(os.listdir(place.removeprefix("file://") + "/data/txn=1")) == 1
    for db in (a, ArrayDatabase.open(spark, place, lease_s=0)):
        with db.transaction() as txn:
            assert rows(txn) == [(1, 1, 1)]


def test_open_leaves_a_live_writers_staged_rows(spark, place):
    a = ArrayDatabase.create(spark, place, XY)
    with a.transaction() as txn:
        txn.add_row((1, 1, 1))
        txn.flush()
        b = ArrayDatabase.open(spark, place)
        assert b.next_txn == 2
        with b.transaction() as other:
            other.add_row((2, 2, 2))
            other.commit()
        txn.commit()
    with ArrayDatabase.open(spark, place, lease_s=0).transaction() as txn:
        assert rows(txn) == [(1, 1, 1), (2, 2, 2)]


def test_cached_snapshots(spark, place):
    db = ArrayDatabase.create(spark, place, XY)
    db.cache()
    for v in (1, 2):
        with db.transaction() as txn:
            txn.add_row((v, 0, v))
            txn.commit()
        with db.transaction() as txn:
            assert [r[0] for r in rows(txn)] == list(range(1, v + 1)) and txn.count() == v
    assert len(db.kept) == 2 and all(x.is_cached for x in db.kept.values())
    db.cache(False)
    with db.transaction() as txn:
        assert db.kept is None and txn.count() == 2


def test_flush_is_spread_over_a_hot_chunk(spark, place):
    db = ArrayDatabase.create(spark, place, ArraySchema([("x", 10**9)], ["v"]))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        with db.transaction() as txn:
            txn.append(spark.range(200_000).selectExpr("id AS x", "id AS v"))
            txn.commit()
            assert len(spark.read.parquet(db.store.segment(1, txn.run, 0)).inputFiles()) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)


def test_dimensions_and_values(spark, tmp_path):
    one = ArrayDatabase.create(spark, f"file://{tmp_path}/one", ArraySchema([("t", 7)], ["a", "b", "c"]))
    with one.transaction() as txn:
        txn.add_rows([(42, 1, 2, 3), (40, 4, 5, 6), (42, 7, 8, 9)])
        assert rows(txn) == [(40, 4, 5, 6), (42, 7, 8, 9)]
    three = ArrayDatabase.create(spark, f"file://{tmp_path}/three", ArraySchema([("a", 2), ("b", 3), ("c", 4)], ["v"]))
    cells = [(a, b, c, a * 100 + b * 10 + c) for a in range(5) for b in range(5) for c in range(5)]
    with three.transaction() as txn:
        txn.add_rows(random.Random(1).sample(cells, len(cells)))
        txn.commit()
    with three.transaction() as txn:
        assert rows(txn) == cells and rows_of(txn.slice({"a": (1, 2), "c": (0, 0)})) == [r for r in cells if 1 <= r[0] <= 2 and r[2] == 0]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_errors(spark, place):
    for bad in (lambda: ArraySchema([], ["v"]), lambda: ArraySchema([("x", 1)], []), lambda: ArraySchema([("x", 0)], ["v"]), lambda: ArraySchema([("x", 1)], ["x"])):
        with pytest.raises(SchemaError):
            bad()
    with pytest.raises(IoError):
        ArrayDatabase.open(spark, place)
    db = ArrayDatabase.create(spark, place, XY)
    with pytest.raises(IoError):
        ArrayDatabase.create(spark, place, XY)
    with db.transaction() as txn:
        with pytest.raises(EngineError):
            db.transaction()
        with pytest.raises(SchemaError):
            txn.add_row((1, 2))
        with pytest.raises(DataError):
            txn.add_row((-1, 2, 3))
        with pytest.raises(SchemaError):
            txn.append(spark.range(1))
        txn.append(spark.sql("select 1L x, -2L y, 3L value"))
        with pytest.raises(DataError):
            txn.flush()


def test_random_operations_against_a_model(spark, place):
    draw, model = random.Random(3), {}
    db = ArrayDatabase.create(spark, place, XY)
    for _ in range(6):
        own = dict(model)
        with db.transaction() as txn:
            for _ in range(draw.randint(1, 3)):
                batch = [(draw.randrange(4), draw.randrange(4), draw.randrange(100)) for _ in range(draw.randint(0, 6))]
                txn.add_rows(batch)
                own |= {r[:2]: r[2] for r in batch}
                if draw.random() < 0.5:
                    txn.flush()
            assert rows(txn) == [(*k, own[k]) for k in sorted(own)]
            if draw.random() < 0.7:
                txn.commit()
                model = own
        if draw.random() < 0.4:
            db = ArrayDatabase.open(spark, place)
    db.compact()
    with ArrayDatabase.open(spark, place).transaction() as txn:
        assert rows(txn) == [(*k, model[k]) for k in sorted(model)]


def test_plans(spark, place):
    db = ArrayDatabase.create(spark, place, XY)
    with db.transaction() as txn:
        txn.add_rows([(1, 1, 1), (2000, 2, 2)])
        txn.commit()
    with db.transaction() as txn:
        plan = txn.slice({"x": (0, 10)}, ordered=False)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(x,0)" in plan and "SortAggregate" not in plan
        keys = txn.versions().select("x", "y").distinct()._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<x:bigint,y:bigint>" in keys


def test_schema_file(spark, place):
    ArrayDatabase.create(spark, place, XY)
    with open(place.removeprefix("file://") + "/schema.json") as f:
        assert f.read() == '{"dimensions":[{"name":"x","chunk_size":1000},{"name":"y","chunk_size":1000}],"values":[{"name":"value"}]}'
