"""The engine's queries over the test tables, each with its SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import dictionary
from gridloom.database import ArrayDatabase
from gridloom.functions.parse import epoch_millis, fixed_point, fixed_point_number, time_millis
from gridloom.operators import blocks
from gridloom.operators.versioning import latest
from gridloom.schema import ArraySchema
from gridloom.sensorlog import SensorLog
from gridloom.sources.sensor_text import parse, split_fields

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path that all executors share."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='gridloom-')}/{name}"


def database(spark: SparkSession, schema: ArraySchema) -> ArrayDatabase:
    return ArrayDatabase.create(spark, folder(spark, "array"), schema)


# -- arrays over the tables ------------------------------------------------------------------------------------


def events_array(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(epoch_millis(F.col("ts")).alias("time_ms"), "user_id", fixed_point_number(F.col("value")).alias("value_milli"))


def events_keyed(spark, sf_dir) -> DataFrame:
    """Key (user_id, event_type), version event_id."""
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", fixed_point_number(F.col("value")).alias("value_milli"))


#: Keys of events as numbers, for the stored arrays.
TYPE_ID = "(ascii(event_type) * 1000 + length(event_type))"
BY_USER = ArraySchema([("user_id", 100), ("type_id", 1000)], ["event_id", "value_milli"])


def stored_events(spark, sf_dir) -> DataFrame:
    return events_keyed(spark, sf_dir).select("user_id", F.expr(f"cast({TYPE_ID} as bigint)").alias("type_id"), "event_id", "value_milli")


MILLI = "CASE WHEN value IS NULL OR value < 0 THEN 0 ELSE CAST(trunc(value * 1000) AS BIGINT) END"
EVENTS_SQL = f"SELECT epoch_us(ts) // 1000 AS time_ms, user_id, {MILLI} AS value_milli FROM events"


def stored_sql(where: str = "true") -> str:
    return f"""
SELECT user_id, CAST(type_id AS BIGINT) AS type_id, max(event_id) AS event_id, arg_max(value_milli, event_id) AS value_milli
FROM (SELECT user_id, {TYPE_ID} AS type_id, event_id, {MILLI} AS value_milli FROM events WHERE {where}) GROUP BY ALL"""


LINE_ORDER = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
LINE_KEYS = ["l_orderkey", "l_linenumber"]


def lineitem_rows(spark, sf_dir) -> DataFrame:
    """Rows with their version: what comes first in LINE_ORDER. Rows that are alike in it differ in no column that is asked for."""
    rows = read(spark, sf_dir, "lineitem")
    first = F.struct("l_partkey", "l_suppkey", "l_quantity").alias("version")
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), first)


def lineitem_latest(spark, sf_dir) -> DataFrame:
    rows = latest(lineitem_rows(spark, sf_dir), LINE_KEYS, [], "version", "version")
    return rows.select(*LINE_KEYS, "version.l_partkey", "version.l_suppkey", F.col("version.l_quantity").cast("long").alias("quantity"))


LINE_ARRAY = ArraySchema([("l_orderkey", 1000), ("l_linenumber", 8)], ["l_partkey", "l_suppkey", "quantity"])
LINE_SQL = f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, CAST(trunc(l_quantity) AS BIGINT) AS quantity
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(c.strip() + " DESC" for c in LINE_ORDER.split(","))}) = 1"""


def positioned(rows: DataFrame, dims: list[str]) -> DataFrame:
    """``rows``, whose keys are unique, with their place in key order. They are written in ranges of keys, with the place
    in the range, and read again; a place is that one and the sizes of the ranges before. No task holds more than a range."""
    spark, where = rows.sparkSession, folder(rows.sparkSession, "places")
    ranges = rows.orderBy(*dims).withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    ranges.withColumn("_place", F.expr("_place & ((1L << 33) - 1)")).write.option("compression", "zstd").parquet(where)
    placed = spark.read.schema(ranges.schema).parquet(where)
    sizes, before = sorted(tuple(r) for r in placed.groupBy("_range").agg(F.max("_place") + 1).collect()), [0]
    for _, size in sizes:
        before.append(before[-1] + size)
    starts = spark.createDataFrame([(r, start) for (r, _), start in zip(sizes, before)], "_range int, _start long")
    return placed.join(F.broadcast(starts), "_range").select(*rows.columns, (F.col("_start") + F.col("_place") + 1).alias("pos"))


# -- scan and versions -----------------------------------------------------------------------------------------


def overwritten(spark, rows: DataFrame, schema: ArraySchema, seq: str) -> ArrayDatabase:
    """A database that first gets all rows with other values, then the rows themselves."""
    db = database(spark, schema)
    other = lambda v: F.when(F.col(v) == 7, 8).otherwise(7).cast("long")
    for now in (rows.withColumns({v: other(v) for v in schema.vals if v != seq}), rows):
        with db.transaction() as txn:
            txn.append(now, seq=seq)
            txn.commit()
    return db


@query(f"SELECT *, row_number() OVER (ORDER BY time_ms, user_id) AS pos FROM (SELECT time_ms, user_id, max(value_milli) AS value_milli FROM ({EVENTS_SQL}) GROUP BY ALL)")
def scan_all(spark, sf_dir):
    """The whole stored array; ``pos`` is a row's place in key order."""
    rows = events_array(spark, sf_dir).withColumn("seq", F.col("value_milli"))
    db = overwritten(spark, rows, ArraySchema([("time_ms", 86_400_000), ("user_id", 100)], ["value_milli"]), "seq")
    return positioned(db.transaction().query(ordered=False), ["time_ms", "user_id"])


@query(f"SELECT * FROM ({LINE_SQL}) ORDER BY l_orderkey, l_linenumber LIMIT 100")
def scan_head(spark, sf_dir):
    rows = lineitem_latest(spark, sf_dir).withColumn("seq", F.lit(0))
    return overwritten(spark, rows, LINE_ARRAY, "seq").transaction().query().limit(100)


@query(f"SELECT user_id, event_type, max(event_id) AS event_id, arg_max({MILLI}, event_id) AS value_milli FROM events GROUP BY ALL")
def latest_version(spark, sf_dir):
    """The stored array's latest rows, its type numbers turned back into names."""
    names = events_keyed(spark, sf_dir).select(F.expr(f"cast({TYPE_ID} as bigint)").alias("type_id"), "event_type").distinct()
    rows = overwritten(spark, stored_events(spark, sf_dir), BY_USER, "event_id").transaction().query(ordered=False)
    return rows.join(names, "type_id").select("user_id", "event_type", "event_id", "value_milli")


@query(LINE_SQL)
def lww_lineitem(spark, sf_dir):
    return lineitem_latest(spark, sf_dir)


@query(stored_sql())
def lww_in_batch(spark, sf_dir):
    """Keys written repeatedly in one transaction; the largest sequence number wins."""
    db = database(spark, BY_USER)
    with db.transaction() as txn:
        txn.append(stored_events(spark, sf_dir), seq="event_id")
        txn.commit()
    with db.transaction() as txn:
        return txn.query(ordered=False)


@query(f"SELECT count(*) AS n_rows FROM ({LINE_SQL})")
def count_rows(spark, sf_dir):
    rows = lineitem_latest(spark, sf_dir).withColumn("seq", F.lit(0))
    return spark.createDataFrame([(overwritten(spark, rows, LINE_ARRAY, "seq").transaction().count(),)], "n_rows long")


@query(LINE_SQL)
def idempotent_reinsert(spark, sf_dir):
    db = database(spark, ArraySchema([("l_orderkey", 1000), ("l_linenumber", 8)], ["l_partkey", "l_suppkey", "quantity"]))
    for _ in range(2):
        with db.transaction() as txn:
            txn.append(lineitem_latest(spark, sf_dir))
            txn.commit()
    with db.transaction() as txn:
        return txn.query(ordered=False)


def _loaded(spark, sf_dir, *parts: str):
    """A database with a transaction for each filter."""
    db, rows = database(spark, BY_USER), stored_events(spark, sf_dir)
    for part in parts:
        with db.transaction() as txn:
            txn.append(rows.where(part), seq="event_id")
            txn.commit()
    return db, rows


def _shares(spark, sf_dir, n: int, below: int | None = None) -> list[str]:
    """Filters that part the events in ``n`` equal ranges of their ids (those less than ``below``)."""
    end = (read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) + 1
    end = end if below is None else min(end, below)
    cuts = [end * i // n for i in range(1, n)]
    low, high = [None, *cuts], [*cuts, below]
    return [" and ".join([f"event_id >= {a}"] * (a is not None) + [f"event_id < {b}"] * (b is not None)) for a, b in zip(low, high, strict=True)]


def _altered(rows: DataFrame) -> DataFrame:
    """All events with another value: what must not be seen, whatever the table's size."""
    return rows.withColumn("value_milli", F.lit(7).cast("long"))


@query(stored_sql("event_id < 5000"))
def snapshot_horizon(spark, sf_dir):
    """Transactions 1, 2 and 3 committed, read below horizon 3."""
    db, rows = _loaded(spark, sf_dir, *_shares(spark, sf_dir, 2, 5000))
    with db.transaction() as txn:
        txn.append(_altered(rows), seq="event_id")
        txn.commit()
    with db.transaction(horizon=3) as txn:
        return txn.query(ordered=False)


@query(stored_sql())
def read_your_writes(spark, sf_dir):
    first, second = _shares(spark, sf_dir, 2)
    db, rows = _loaded(spark, sf_dir, first)
    txn = db.transaction()
    txn.append(rows.where(second), seq="event_id")
    return txn.query(ordered=False)


@query(stored_sql("event_id < 5000"))
def rollback_view(spark, sf_dir):
    db, rows = _loaded(spark, sf_dir, "event_id < 5000")
    with db.transaction() as txn:
        txn.append(_altered(rows), seq="event_id")
        txn.flush()
        txn.rollback()
    with db.transaction() as txn:
        return txn.query(ordered=False)


@query(stored_sql())
def multi_segment_txn(spark, sf_dir):
    db, rows = database(spark, BY_USER), stored_events(spark, sf_dir)
    with db.transaction() as txn:
        for part in _shares(spark, sf_dir, 3):
            txn.append(rows.where(part), seq="event_id")
            txn.flush()
        txn.commit()
    with db.transaction() as txn:
        return txn.query(ordered=False)


@query(stored_sql())
def reopen_database(spark, sf_dir):
    """Committed rows after opening the directory again; staged ones are gone."""
    db, rows = _loaded(spark, sf_dir, *_shares(spark, sf_dir, 2))
    left = db.transaction()
    left.append(rows.withColumn("value_milli", F.lit(7).cast("long")))
    left.flush()
    db = ArrayDatabase.open(spark, db.path, lease_s=0)
    with db.transaction() as txn:
        return txn.query(ordered=False)


@query(stored_sql())
def compacted_database(spark, sf_dir):
    db, _ = _loaded(spark, sf_dir, *_shares(spark, sf_dir, 2))
    db.compact()
    with db.transaction() as txn:
        return txn.query(ordered=False)


# -- blocks ----------------------------------------------------------------------------------------------------

LINES = ArraySchema([("l_orderkey", 1000), ("l_partkey", 100)], ["quantity"])
CHUNKED = "SELECT *, l_orderkey // 1000 AS l_orderkey__chunk, l_partkey // 100 AS l_partkey__chunk FROM lineitem"
ORDERS = ArraySchema([("o_custkey", 100), ("priority", 10)], ["o_orderkey"])
PRIORITY = "CAST(substr(o_orderpriority, 1, 1) AS BIGINT)"


def line_blocks(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"))


@query(f"SELECT l_orderkey__chunk, l_partkey__chunk, count(*) AS n_rows FROM ({CHUNKED}) GROUP BY ALL")
def chunk_counts(spark, sf_dir):
    return blocks.chunk_counts(line_blocks(spark, sf_dir), LINES)


@query(
    f"SELECT l_orderkey__chunk, l_partkey__chunk, count(*) AS n_rows, min(l_orderkey) AS min_l_orderkey, max(l_orderkey) AS max_l_orderkey, "
    f"min(l_partkey) AS min_l_partkey, max(l_partkey) AS max_l_partkey FROM ({CHUNKED}) GROUP BY ALL"
)
def block_bounds(spark, sf_dir):
    return blocks.block_bounds(line_blocks(spark, sf_dir), LINES)


@query(
    f"SELECT l_orderkey__chunk, l_partkey__chunk, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS l_orderkey_vector, "
    f"array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS l_partkey_vector FROM ({CHUNKED}) GROUP BY ALL"
)
def block_dimension_vectors(spark, sf_dir):
    vectors = blocks.dimension_vectors(line_blocks(spark, sf_dir), LINES)
    text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)
    return vectors.select(*blocks.chunks(LINES), text("l_orderkey_vector"), text("l_partkey_vector"))


@query(
    f"SELECT l_orderkey__chunk, l_partkey__chunk, count(DISTINCT l_orderkey) * count(DISTINCT l_partkey) AS cells, count(DISTINCT (l_orderkey, l_partkey)) AS present, "
    f"count(DISTINCT l_orderkey) * count(DISTINCT l_partkey) - count(DISTINCT (l_orderkey, l_partkey)) AS missing FROM ({CHUNKED}) GROUP BY ALL"
)
def block_density(spark, sf_dir):
    return blocks.block_density(line_blocks(spark, sf_dir), LINES)


def order_cells(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("long").alias("priority"), "o_orderkey", F.col("o_orderkey").alias("version"))
    return latest(rows, ["o_custkey", "priority"], ["o_orderkey"], "version")


CELLS_SQL = f"SELECT o_custkey, {PRIORITY} AS priority, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL"


@query(
    f"""
WITH cell AS ({CELLS_SQL}),
     c AS (SELECT DISTINCT o_custkey // 100 AS o_custkey__chunk, priority // 10 AS priority__chunk, o_custkey FROM cell),
     p AS (SELECT DISTINCT o_custkey // 100 AS o_custkey__chunk, priority // 10 AS priority__chunk, priority FROM cell)
SELECT c.o_custkey__chunk, c.priority__chunk, c.o_custkey, p.priority, cell.o_orderkey
FROM c JOIN p USING (o_custkey__chunk, priority__chunk) LEFT JOIN cell ON cell.o_custkey = c.o_custkey AND cell.priority = p.priority"""
)
def dense_cells(spark, sf_dir):
    return blocks.densify(order_cells(spark, sf_dir), ORDERS)


@query(CELLS_SQL)
def dense_to_rows(spark, sf_dir):
    return blocks.sparsify(blocks.densify(order_cells(spark, sf_dir), ORDERS), ORDERS)


# -- text and parsing ------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE CAST(trunc(c_acctbal * 1000) AS BIGINT) END AS acctbal_milli FROM customer")
def fixed_point_text(spark, sf_dir):
    """Negative decimals in text become 0."""
    return read(spark, sf_dir, "customer").select("c_custkey", fixed_point(F.col("c_acctbal").cast("string")).alias("acctbal_milli"))


@query(f"SELECT event_id, {MILLI} AS value_milli FROM events")
def fixed_point_events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", fixed_point_number(F.col("value")).alias("value_milli"))


@query("SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS order_ms FROM orders")
def epoch_millis_orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", epoch_millis(F.col("o_orderdate")).alias("order_ms"))


def event_lines(spark, sf_dir) -> DataFrame:
    """Events as lines of a sensor log."""
    half = F.when(F.date_format("ts", "a") == "AM", "a.m.").otherwise("p.m.")
    time = F.concat_ws(" ", F.date_format("ts", "dd/MM/yyyy hh:mm:ss"), half)
    value = F.format_string("%.3f", F.floor(F.col("value") * 1000) / 1000)  # cut, not rounded: engines round ties differently
    return read(spark, sf_dir, "events").select(
        "event_id", F.concat_ws("\t", time, F.concat(F.lit("user"), F.col("user_id") % 10), "event_type", F.lit("reading"), value).alias("line")
    )


@query("SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000 AS time_ms FROM events")
def time_parse(spark, sf_dir):
    return event_lines(spark, sf_dir).select("event_id", time_millis(F.split("line", "\t")[0]).alias("time_ms"))


@query("SELECT event_id, 'user' || (user_id % 10) AS component, event_type AS sensor, 'reading' AS kind, epoch_us(date_trunc('second', ts)) // 1000 AS time_ms FROM events")
def tsv_parse(spark, sf_dir):
    fields = split_fields(event_lines(spark, sf_dir), "event_id")
    return fields.select("event_id", "component", "sensor", "kind", time_millis(F.col("time")).alias("time_ms"))


@query("SELECT CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE 'good' END AS lines, count(*) AS n_rows FROM events GROUP BY ALL")
def reject_lines(spark, sf_dir):
    """Every seventh line is spoilt in one of five ways."""
    lines, way = event_lines(spark, sf_dir), F.expr("event_id div 7") % 5
    spoilt = (
        F.when(way == 0, F.concat("line", F.lit("\textra")))
        .when(way == 1, F.lit(""))
        .when(way == 2, F.concat("line", F.lit("\r")))
        .when(way == 3, F.lit("31/02/2020 01:00:00 a.m.\ta\tb\tc\t1"))
        .otherwise(F.concat("line", F.lit("f")))
    )
    parsed = parse(lines.select(F.when(F.col("event_id") % 7 == 0, spoilt).otherwise(F.col("line")).alias("line")))
    return parsed.groupBy(F.when(F.col("ok"), "good").otherwise("bad").alias("lines")).agg(F.count(F.lit(1)).alias("n_rows"))


DICT_KEYS = ["segment", "nation"]


def customer_keys(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.format_string("%02d", "c_nationkey").alias("nation"))


KEYS_SQL = "SELECT c_custkey, c_mktsegment AS segment, printf('%02d', c_nationkey) AS nation FROM customer"


@query(f"SELECT c_custkey, dense_rank() OVER (ORDER BY segment, nation) AS id FROM ({KEYS_SQL})")
def dict_encode(spark, sf_dir):
    rows = customer_keys(spark, sf_dir)
    return dictionary.encode(rows, dictionary.extend(dictionary.empty(spark, DICT_KEYS), rows, DICT_KEYS), DICT_KEYS)


@query(
    f"""
WITH k AS ({KEYS_SQL}), old AS (SELECT segment, nation, dense_rank() OVER (ORDER BY segment, nation) AS id FROM (SELECT DISTINCT segment, nation FROM k WHERE c_custkey % 40 = 0)),
     fresh AS (SELECT DISTINCT segment, nation FROM k ANTI JOIN old USING (segment, nation))
SELECT id, segment, nation FROM old
UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY segment, nation), segment, nation FROM fresh"""
)
def dict_incremental(spark, sf_dir):
    """A dictionary of some rows, extended by all: new ids start after the largest."""
    rows = customer_keys(spark, sf_dir)
    first = dictionary.extend(dictionary.empty(spark, DICT_KEYS), rows.where("c_custkey % 40 = 0"), DICT_KEYS)
    return dictionary.extend(first, rows, DICT_KEYS)


# -- more dimensions and values, slices ------------------------------------------------------------------------


def stored(spark, rows, schema):
    db = database(spark, schema)
    with db.transaction() as txn:
        txn.append(rows)
        txn.commit()
    return db.transaction()


@query(f"SELECT event_id, {MILLI} AS value_milli, row_number() OVER (ORDER BY event_id) AS pos FROM events")
def array_1d(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", fixed_point_number(F.col("value")).alias("value_milli"))
    return positioned(stored(spark, rows, ArraySchema([("event_id", 500)], ["value_milli"])).query(ordered=False), ["event_id"])


ROWS_3D = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, max(CAST(trunc(l_quantity) AS BIGINT)) AS quantity FROM lineitem GROUP BY ALL"


@query(f"SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey) AS pos FROM ({ROWS_3D})")
def array_3d(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_suppkey", F.col("l_quantity").cast("long").alias("quantity"))
    schema = ArraySchema([("l_orderkey", 1000), ("l_linenumber", 4), ("l_suppkey", 10)], ["quantity"])
    db = database(spark, schema)
    with db.transaction() as txn:
        txn.append(rows, seq="quantity")
        txn.commit()
    return positioned(db.transaction().query(ordered=False), schema.dims)


@query(LINE_SQL)
def multi_value(spark, sf_dir):
    schema = ArraySchema([("l_orderkey", 1000), ("l_linenumber", 8)], ["l_partkey", "l_suppkey", "quantity"])
    return stored(spark, lineitem_latest(spark, sf_dir), schema).query(ordered=False)


@query(f"SELECT * FROM ({LINE_SQL}) WHERE l_orderkey BETWEEN 1000 AND 2999 AND l_linenumber BETWEEN 2 AND 3")
def slice_range(spark, sf_dir):
    schema = ArraySchema([("l_orderkey", 1000), ("l_linenumber", 8)], ["l_partkey", "l_suppkey", "quantity"])
    return stored(spark, lineitem_latest(spark, sf_dir), schema).slice({"l_orderkey": (1000, 2999), "l_linenumber": (2, 3)}, ordered=False)


@query(
    f"SELECT time_ms // 86400000 * 86400000 AS time_ms, count(*) AS n_rows, CAST(sum(value_milli) AS BIGINT) AS sum_value_milli, min(value_milli) AS min_value_milli, "
    f"max(value_milli) AS max_value_milli FROM (SELECT time_ms, user_id, max(value_milli) AS value_milli FROM ({EVENTS_SQL}) GROUP BY ALL) GROUP BY 1"
)
def rollup_days(spark, sf_dir):
    db = database(spark, ArraySchema([("time_ms", 86_400_000), ("user_id", 100)], ["value_milli"]))
    with db.transaction() as txn:
        txn.append(events_array(spark, sf_dir), seq="value_milli")
        txn.commit()
    return db.transaction().rollup("time_ms", 86_400_000)


SENSOR_SQL = """
WITH line AS (
  SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000 AS time, 'user' || (user_id % 10) AS component, event_type AS sensor,
         CASE WHEN value < 0 THEN 0 ELSE CAST(trunc(floor(value * 1000) / 1000 * 1000) AS BIGINT) END AS value FROM events
), one AS (SELECT time, component, sensor, arg_max(value, event_id) AS value FROM line GROUP BY ALL),
ids AS (SELECT component, sensor, row_number() OVER (ORDER BY component, sensor) AS sensor_id FROM (SELECT DISTINCT component, sensor FROM line))
SELECT time, sensor_id, value FROM one JOIN ids USING (component, sensor)"""


@query(SENSOR_SQL)
def sensor_log(spark, sf_dir):
    """Events as text, parsed, encoded, appended, committed and read; of one key the line of the largest event_id wins."""
    return sensor_rows(spark, sf_dir).select("time", "sensor_id", "value")


def sensor_rows(spark, sf_dir) -> DataFrame:
    db = database(spark, ArraySchema([("unused", 1)], ["unused_value"]))
    log = SensorLog(spark, db.path + "-log")
    log.load_lines(event_lines(spark, sf_dir), seq="event_id")
    return log.rows()
