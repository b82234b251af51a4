"""The catalogue's queries on tables that repeat rows, as larger copies of the test tables do."""

import duckdb
import pytest

from gridloom.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
KEYS = {"events": {"event_id": 1000, "user_id": 5000}, "lineitem": {"l_orderkey": 10_000}}


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """events and lineitem three times, with shifted keys."""
    out, db = tmp_path_factory.mktemp("repeated"), duckdb.connect()
    for table, shifts in KEYS.items():
        shifted = ", ".join(f"{c} + i * {by} AS {c}" for c, by in shifts.items())
        db.execute(f"COPY (SELECT * REPLACE ({shifted}) FROM range(3) r(i), '{DATA}/{table}.parquet') TO '{out}/{table}.parquet'")
    return out


def same_as_sql(spark, name, data):
    db = duckdb.connect()
    for t in KEYS:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, str(data)).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_equal_lines_of_several_events_stay_apart(spark, repeated):
    same_as_sql(spark, "tsv_parse", repeated)


def test_parsed_fields_are_computed_once_a_row(spark):
    """A filter on parsed fields moved below them and repeated the line's own expression hundreds of times."""
    from pyspark.sql import functions as F

    from gridloom.sources.sensor_text import good, parse

    lines = spark.range(3).select("id", F.format_string("01/02/2020 01:00:00 a.m.\tc\ts\tk\t%d", "id").alias("line"))
    rows = good(parse(lines, "id"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("format_string") == 1
    assert sorted(r.value_milli for r in rows.collect()) == [0, 1000, 2000]


@pytest.mark.parametrize("name", ["array_1d", "array_3d", "scan_all"])
def test_no_task_numbers_the_whole_array(spark, repeated, name):
    assert "Window" not in QUERIES[name](spark, str(repeated))._jdf.queryExecution().optimizedPlan().toString()
    same_as_sql(spark, name, repeated)


def test_places_of_no_rows(spark):
    from gridloom.plans.catalogue import positioned

    assert positioned(spark.range(0), ["id"]).collect() == []
    assert sorted(positioned(spark.createDataFrame([(5,), (2,), (9,)], "id long"), ["id"]).collect()) == [(2, 1), (5, 2), (9, 3)]


def below_exchange(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("Exchange hashpartitioning") :]


def test_lineitem_versions_move_once_with_what_they_need(spark, repeated):
    from gridloom.plans.catalogue import lineitem_latest

    moved = below_exchange(lineitem_latest(spark, str(repeated)))
    assert "Aggregate" not in moved and "l_shipdate" not in moved
    same_as_sql(spark, "idempotent_reinsert", repeated)


def test_tasks_that_read_segments_hold_no_keys(spark, repeated):
    assert "Aggregate" not in below_exchange(QUERIES["scan_head"](spark, str(repeated)))


def test_count_brings_keys_together_first(spark, repeated, monkeypatch):
    from gridloom import transaction

    made, latest = [], transaction.latest
    monkeypatch.setattr(transaction, "latest", lambda *a: made.append(latest(*a)) or made[-1])
    same_as_sql(spark, "count_rows", repeated)
    assert "_version" in made[-1].columns and "Aggregate" not in below_exchange(made[-1])
