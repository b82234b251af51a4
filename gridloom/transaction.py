"""Transactions: a transient view for updates and queries, committed as a whole or not at all."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import DataError, EngineError, SchemaError
from gridloom.operators.blocks import chunks, with_chunks
from gridloom.operators.versioning import SEGMENTS, check_segment, latest

#: The transaction id that a transaction's own unsaved rows show: a fixed value.
OWN_TXN = 4294967295


class Transaction:
    def __init__(self, db, horizon: int):
        if db.open_transaction is not None:
            raise EngineError("the database has an open transaction")
        self.db, self.schema, self.horizon = db, db.schema, horizon
        self.txn: int | None = None
        self.run = uuid.uuid4().hex  # names this writer's files
        self.segments: list[int] = []
        self.unsaved: list[DataFrame] = []
        self.extra: dict = {}
        self.open = True
        db.open_transaction = self

    # -- writing -------------------------------------------------------------------------------------------

    def add_rows(self, rows) -> None:
        """Upsert rows in their order: of one key the last wins."""
        names = self.schema.names
        listed = [tuple(r) for r in rows]
        if any(len(r) != len(names) for r in listed):
            raise SchemaError(f"a row has {len(names)} fields: {names}")
        if any(not isinstance(x, int) or isinstance(x, bool) or not 0 <= x < 1 << 63 for r in listed for x in r):
            raise DataError("fields are whole numbers from 0 to 2^63 - 1")
        kind = T.StructType([T.StructField(n, T.LongType()) for n in [*names, "_seq"]])
        self._add(self.db.spark.createDataFrame([(*r, i) for i, r in enumerate(listed)], kind))

    def add_row(self, row) -> None:
        self.add_rows([row])

    def append(self, df: DataFrame, seq: str | None = None) -> None:
        """Upsert a DataFrame. Of one key the row with the largest ``seq`` wins; without it rows' own order decides,
        which is defined for a local list or a sorted file only. Flush first what is not deterministic."""
        if missing := [n for n in self.schema.names if n not in df.columns]:
            raise SchemaError(f"columns are missing: {missing}")
        fields = {f.name: f.dataType for f in df.schema}
        if wrong := [n for n in self.schema.names if not isinstance(fields[n], T.IntegralType)]:
            raise SchemaError(f"columns are no whole numbers: {wrong}")
        order = F.monotonically_increasing_id() if seq is None else F.col(seq).cast("long")
        self._add(df.select(*(F.col(n).cast("long").alias(n) for n in self.schema.names), order.alias("_seq")))

    def _add(self, df: DataFrame) -> None:
        self._check_open()
        self.unsaved.append(df)

    def _own(self) -> DataFrame:
        """Unsaved rows, one for each key; values that can't be stored fail the query. Each batch gives its latest rows by
        their order, and these give theirs by batch."""
        dims, vals, first = self.schema.dims, self.schema.vals, self.schema.dims[0]
        bad = reduce(lambda a, b: a | b, (F.col(n).isNull() | (F.col(n) < 0) for n in self.schema.names))
        error = F.raise_error(F.lit("fields are whole numbers from 0 to 2^63 - 1")).cast("long")
        one = [latest(df.withColumn(first, F.when(bad, error).otherwise(F.col(first))), dims, vals, "_seq") for df in self.unsaved]
        if len(one) == 1:
            return one[0]
        return latest(reduce(DataFrame.unionByName, (df.withColumn("_batch", F.lit(i)) for i, df in enumerate(one))), dims, vals, "_batch")

    def flush(self) -> None:
        """Write the unsaved rows as a new segment; nothing if there are none."""
        self._check_open()
        if not self.unsaved:
            return
        fresh = self.txn is None
        if fresh:
            self.txn = self.db.allocate()
        seg = len(self.segments)
        check_segment(seg)
        where, names = self.db.store.segment(self.txn, self.run, seg), chunks(self.schema)
        try:
            # A chunk may hold most of the rows: rebalancing splits its partition where repartitioning could not.
            (
                with_chunks(self._own(), self.schema)
                .hint("rebalance", *map(F.col, names))
                .sortWithinPartitions(*self.schema.dims)
                .drop(*names)
                .write.option("compression", "zstd")
                .parquet(where)
            )
        except Exception as e:
            if "fields are whole numbers" in str(e):
                raise DataError("fields are whole numbers from 0 to 2^63 - 1") from e
            raise
        self.unsaved = []
        if not self.db.spark.read.schema(self.schema.struct_type()).parquet(where).isEmpty():
            self.segments.append(seg)
            return
        self.db.store.delete("data", f"txn={self.txn}", f"run={self.run}", f"seg={seg}")
        if fresh:  # no rows, no id
            self.db.store.discard(self.txn, self.run)
            self.txn = None
            self.db.next_txn -= 1

    def commit(self, compacted: bool = False) -> None:
        """Flush and publish all segments at once. Without rows nothing is written and no id is used."""
        self.flush()
        if self.txn is not None:
            manifest = {"run": self.run, "segments": self.segments} | ({"compacted": True} if compacted else {}) | self.extra
            self.db.store.commit(self.txn, manifest)
            self.db.commits[self.txn] = {"txn": self.txn} | manifest
        self._close()

    def rollback(self) -> None:
        self._check_open()
        if self.txn is not None:
            self.db.store.discard(self.txn, self.run)
        self._close()

    def _close(self) -> None:
        self.unsaved, self.open, self.db.open_transaction = [], False, None

    def _check_open(self) -> None:
        if not self.open:
            raise EngineError("the transaction is over")

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, *_) -> None:
        if self.open:
            self.rollback()

    # -- reading -------------------------------------------------------------------------------------------

    def _stored(self) -> list[tuple[int, str, int]]:
        """The segments of the snapshot and this transaction's own."""
        return self.db.visible(self.horizon) + [(self.txn, self.run, s) for s in self.segments]

    def versions(self) -> DataFrame:
        """All visible rows with their ``_version``: committed ones, own segments and unsaved ones."""
        self._check_open()
        own, out = self.segments, self.db.read(self._stored())
        if own:  # own rows are newer than any committed, whatever the horizon
            out = out.withColumn("_version", F.when(F.col("_version") >= self.txn * SEGMENTS, F.col("_version") % SEGMENTS + OWN_TXN * SEGMENTS).otherwise(F.col("_version")))
        if self.unsaved:
            out = out.unionByName(self._own().withColumn("_version", F.lit(OWN_TXN * SEGMENTS + len(self.segments)).cast("long")))
        return out

    def _single(self) -> bool:
        """Whether keys are unique as they are: a segment holds each once, and so do the unsaved rows."""
        return len(self._stored()) + bool(self.unsaved) <= 1

    def query(self, ordered: bool = True, with_txn: bool = False) -> DataFrame:
        """One row, the latest, for each visible key, in key order; ``_txn`` is its transaction (4294967295: own)."""
        rows, dims = self.versions(), self.schema.dims
        if not self._single():
            rows = latest(rows, dims, self.schema.vals, "_version", "_version" if with_txn else None)
        elif not with_txn:
            rows = rows.drop("_version")
        if with_txn:
            rows = rows.withColumn("_txn", F.expr(f"_version div {SEGMENTS}")).drop("_version")
        return rows.orderBy(*self.schema.dims) if ordered else rows

    def count(self) -> int:
        """Visible keys; reads the dimensions only."""
        keys = self.versions().select(*self.schema.dims, "_version")
        if self._single():
            return keys.count()
        parts = int(self.db.spark.conf.get("spark.sql.shuffle.partitions"))  # keys alone are so small that parts put together by bytes hold too many
        return latest(keys, self.schema.dims, [], "_version", "_version", parts).agg(F.count("_version")).first()[0]

    def slice(self, ranges: dict[str, tuple[int, int]], ordered: bool = True) -> DataFrame:
        """The rows whose dimensions lie in closed ranges; the filter reaches the scan's statistics."""
        if unknown := set(ranges) - set(self.schema.dims):
            raise SchemaError(f"no such dimensions: {sorted(unknown)}")
        rows = self.query(ordered=False)
        for d, (low, high) in ranges.items():
            rows = rows.where(F.col(d).between(low, high))
        return rows.orderBy(*self.schema.dims) if ordered else rows

    def rollup(self, dimension: str, chunk: int) -> DataFrame:
        """For each bucket of a dimension: rows, and the sum, least and largest of each value."""
        sums = [f(v).alias(f"{n}_{v}") for v in self.schema.vals for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max))]
        return self.query(ordered=False).groupBy(F.expr(f"`{dimension}` div {chunk}L * {chunk}L").alias(dimension)).agg(F.count(F.lit(1)).alias("n_rows"), *sums)

    def view(self, name: str) -> None:
        self.query(ordered=False).createOrReplaceTempView(name)
