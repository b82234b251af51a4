"""Sensor logs as an array database: ``python -m gridloom.sensorlog DATABASE load FILE... | list | count``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import dictionary
from gridloom.database import ArrayDatabase
from gridloom.schema import ArraySchema
from gridloom.sources.sensor_text import good, parse, read_lines, rejected

#: Lines after which a load of files flushes a segment.
FLUSH_ROWS = 10_000_000
KEYS = ["component", "sensor", "kind"]
SCHEMA = ArraySchema([("time", 86_400_000), ("sensor_id", 100)], ["value"])


class SensorLog:
    """The dictionary is saved with the transaction that needs it, under its id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.db = spark, ArrayDatabase.open_or_create(spark, path, SCHEMA)

    def sensors(self) -> DataFrame:
        last = max((t for t, m in self.db.commits.items() if m.get("dictionary")), default=None)
        if last is None:
            return dictionary.empty(self.spark, KEYS)
        return dictionary.from_json(self.spark, self.db.store.read_text(self.db.commits[last]["dictionary"]), KEYS)

    def load_lines(self, lines: DataFrame, seq: str | None = None, flush_rows: int | None = None) -> DataFrame:
        """Parse, encode, append and commit; the rejected lines. Of one time and sensor the line with the largest
        ``seq`` wins, without it the last line; the order is taken before any join. With ``flush_rows`` a
        longer load is flushed in segments of about so many lines, parted by key, so that the order holds."""
        order = F.monotonically_increasing_id() if seq is None else F.col(seq).cast("long")
        parsed = parse(lines.select("line", order.alias("_line")), "_line")
        rows, known = good(parsed), self.sensors()
        had = known.count()
        now = dictionary.extend(known, rows, KEYS).cache()
        entries = now.count()
        coded = dictionary.encode(rows, now, KEYS, "sensor_id", entries).select(F.col("time_ms").alias("time"), "sensor_id", F.col("value_milli").alias("value"), "_line")
        with self.db.transaction() as txn:
            if flush_rows:
                coded = coded.persist()
            parts = max(1, -(-coded.count() // flush_rows)) if flush_rows else 1
            for part in range(parts):
                txn.append(coded.where(F.pmod(F.xxhash64("time", "sensor_id"), F.lit(parts)) == part) if parts > 1 else coded, seq="_line")
                txn.flush()
            if flush_rows:
                coded.unpersist()
            if txn.txn is not None and entries > had:
                name = f"sensors-{txn.txn:08x}.json"
                self.db.store.write_new(dictionary.to_json(now), name)
                txn.extra["dictionary"] = name
            txn.commit()
        now.unpersist()
        return rejected(parsed)

    def load(self, patterns: list[str], flush_rows: int | None = FLUSH_ROWS) -> DataFrame:
        return self.load_lines(read_lines(self.spark, patterns), flush_rows=flush_rows)

    def rows(self) -> DataFrame:
        with self.db.transaction() as txn:
            return txn.query()

    def count(self) -> int:
        with self.db.transaction() as txn:
            return txn.count()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridloom.sensorlog", description=__doc__)
    parser.add_argument("database")
    parser.add_argument("command", choices=["load", "list", "count"])
    parser.add_argument("files", nargs="*")
    said = parser.parse_args(args)
    spark = SparkSession.builder.appName("sensorlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    log, began = SensorLog(spark, said.database), time.time()
    if said.command == "load":
        for row in log.load(said.files).toLocalIterator():
            print(f"not parsed: {row.line!r}")
        print(f"loaded in {time.time() - began:.3f} s")
    elif said.command == "list":
        n = 0
        for n, row in enumerate(log.rows().toLocalIterator(), 1):
            print(*row)
        print(f"{n} rows in {time.time() - began:.3f} s")
    else:
        print(f"{log.count()} rows in {time.time() - began:.3f} s")


if __name__ == "__main__":
    main()
