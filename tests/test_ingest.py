import gzip
import json

import pytest
from pyspark.sql import functions as F

from gridloom.errors import IoError
from gridloom.functions.parse import fixed_point, time_millis
from gridloom.sensorlog import SensorLog
from gridloom.sources.sensor_text import parse


def test_fixed_point(spark):
    cases = {"": 0, "1.2345": 1234, "-3": 0, "1e3": 1_000_000, "inf": (1 << 63) - 1, "-inf": 0, "nan": 0, "5f": None, " 5": None, "5\r": None, "5\n": None, ".5": 500, "5.": 5000, "x": None, "1e30": (1 << 63) - 1}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.v for r in df.select("s", fixed_point(F.col("s")).alias("v")).collect()} == cases


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times(spark, zone):
    cases = {"01/01/1970 12:00:00 a.m.": 0, "01/01/1970 12:00:00 p.m.": 43_200_000, "2/1/1970 1:02:03 am": 90_123_000, "31/02/2020 01:00:00 a.m.": None, "01/01/1970 13:00:00 p.m.": None, "": None}
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(k,) for k in cases], "s string")
        assert {r.s: r.v for r in df.select("s", time_millis(F.col("s")).alias("v")).collect()} == cases
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_lines(spark):
    good = "01/01/2020 01:00:00 a.m.\ta\tb\tc\t1"
    lines = [good, "\0\0" + good, good + "\tx", "01/01/2020 01:00:00 a.m.\ta\tb\tc", "", good + "\r", "01/01/2020 01:00:00 a.m.\ta\tb\tc\t"]
    df = spark.createDataFrame(list(enumerate(lines)), "i long, line string").withColumn("line", F.regexp_replace("line", "^\\x00+", ""))
    found = parse(df.orderBy("i").select("line")).collect()
    assert [r.ok for r in found] == [True, True, False, False, False, False, True]


def test_sensor_log(spark, tmp_path):
    line = "0{d}/01/2020 0{h}:00:00 {half}\tc{c}\ts\tk\t{v}"
    first = [line.format(d=1, h=1, half="a.m.", c=2, v="1.5"), line.format(d=1, h=1, half="p.m.", c=1, v="2"), "broken"]
    (tmp_path / "one.log").write_text("\n".join(first) + "\n")
    with gzip.open(tmp_path / "two.log.gz", "wt") as f:
        f.write(line.format(d=1, h=1, half="a.m.", c=0, v="9") + "\n" + first[0].replace("1.5", "7") + "\n")
    place = f"file://{tmp_path}/db"
    log = SensorLog(spark, place)
    assert [r.line for r in log.load([f"file://{tmp_path}/one*"]).collect()] == ["broken"]
    assert [tuple(r) for r in log.rows().collect()] == [(1577840400000, 2, 1500), (1577883600000, 1, 2000)]
    log = SensorLog(spark, place)
    log.load([f"file://{tmp_path}/*.log.gz"])
    assert sorted((r.id, r.component) for r in log.sensors().collect()) == [(1, "c1"), (2, "c2"), (3, "c0")]
    assert log.count() == 3 and (1577840400000, 2, 7000) in [tuple(r) for r in log.rows().collect()]
    assert json.loads(log.db.store.read_text("sensors-00000002.json"))[0] == {"id": 1, "component": "c1", "sensor": "s", "kind": "k"}
    with pytest.raises(IoError):
        log.load([f"file://{tmp_path}/none*"])


@pytest.mark.parametrize("entries", [200_000, 0])
def test_last_line_wins_however_the_dictionary_is_joined(spark, tmp_path, monkeypatch, entries):
    from gridloom import dictionary

    monkeypatch.setattr(dictionary, "BROADCAST_ENTRIES", entries)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = [(i, -i, f"01/01/2020 01:00:00 a.m.\tc{i % 50}\ts\tk\t{i}") for i in range(2000)]
        df = spark.createDataFrame(lines, "i long, back long, line string").repartitionByRange(8, "i").sortWithinPartitions("i")
        for seq, first in ((None, 1950), ("i", 1950), ("back", 0)):
            log = SensorLog(spark, f"file://{tmp_path}/{seq}")
            log.load_lines(df, seq)
            names = {r.id: int(r.component[1:]) for r in log.sensors().collect()}
            assert {names[r.sensor_id]: r.value for r in log.rows().collect()} == {c: (first + c) * 1000 for c in range(50)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sensor_rows_hold_the_last_event(spark):
    from gridloom.plans.catalogue import event_lines, sensor_rows

    data, last = "/root/testdata/sf0.001", {}
    for r in sorted(parse(event_lines(spark, data), "event_id").collect(), key=lambda r: r.event_id):
        last[r.time_ms, r.component, r.sensor] = r.value_milli
    ids = {k: i for i, k in enumerate(sorted({k[1:] for k in last}), 1)}
    assert {(r.time, r.sensor_id): r.value for r in sensor_rows(spark, data).collect()} == {(t, ids[c, s]): v for (t, c, s), v in last.items()}


def test_null_keys_have_one_id_and_keep_their_rows(spark):
    from gridloom import dictionary

    rows = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "a", "b"), (4, "a", None)], "n long, x string, y string")
    once = dictionary.extend(dictionary.empty(spark, ["x", "y"]), rows, ["x", "y"])
    twice = dictionary.extend(once, rows, ["x", "y"])
    assert twice.count() == once.count() == 3
    found = {r.n: r.id for r in dictionary.encode(rows, twice, ["x", "y"]).collect()}
    assert sorted(found) == [1, 2, 3, 4] and found[1] == found[4] and len(set(found.values())) == 3


def test_stream_batches_count_once(spark, tmp_path):
    from gridloom.database import ArrayDatabase
    from gridloom.schema import ArraySchema
    from gridloom.streaming.ingest import array_sink

    place = f"file://{tmp_path}/db"
    ArrayDatabase.create(spark, place, ArraySchema([("k", 10)], ["v"]))
    write = array_sink(place)
    for batch in (0, 0, 1):
        write(spark.createDataFrame([(1, batch + 1), (batch + 2, 5)], "k long, v long"), batch)
    db = ArrayDatabase.open(spark, place)
    assert len(db.commits) == 2
    with db.transaction() as txn:
        assert [tuple(r) for r in txn.query().collect()] == [(1, 2), (2, 5), (3, 5)]


def test_load_flushes_segments_and_the_last_line_still_wins(spark, tmp_path):
    lines = [f"01/01/2020 01:00:00 a.m.\tc{i % 40}\ts\tk\t{i}" for i in range(400)]
    (tmp_path / "a.log").write_text("\n".join(lines))
    log = SensorLog(spark, f"file://{tmp_path}/db")
    log.load([f"file://{tmp_path}/a.log"], flush_rows=150)
    assert log.db.commits[1]["segments"] == [0, 1, 2]
    names = {r.id: int(r.component[1:]) for r in log.sensors().collect()}
    assert {names[r.sensor_id]: r.value for r in log.rows().collect()} == {c: (360 + c) * 1000 for c in range(40)}


def test_command_line(spark, tmp_path, capsys):
    from gridloom.sensorlog import main

    (tmp_path / "a.log").write_text("01/01/2020 01:00:00 a.m.\tb\ts\tk\t1.5\nbroken\n01/01/2020 01:00:00 a.m.\ta\ts\tk\t\n")
    place = f"file://{tmp_path}/db"
    for command, files, said in (("load", [f"file://{tmp_path}/a.log"], ["not parsed: 'broken'", "loaded in"]), ("list", [], ["1577840400000 1 0", "1577840400000 2 1500", "2 rows in"]), ("count", [], ["2 rows in"])):
        main([place, command, *files])
        out = capsys.readouterr().out.strip().split("\n")
        assert [o.startswith(s) for o, s in zip(out, said, strict=True)] == [True] * len(said), out
