"""Array databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gridloom.errors import IoError
from gridloom.operators.versioning import pack_version
from gridloom.schema import ArraySchema
from gridloom.sources.storage import LEASE_S, Store
from gridloom.transaction import Transaction


#: Snapshots that a handle keeps cached.
CACHED = 100


class ArrayDatabase:
    """A directory of committed segments. One handle has one open transaction at a time; of two processes that
    commit one transaction id, one fails, and neither touches the other's files."""

    def __init__(self, spark: SparkSession, store: Store, schema: ArraySchema, commits: dict[int, dict], next_txn: int):
        self.spark, self.store, self.schema = spark, store, schema
        self.commits, self.next_txn, self.open_transaction = commits, next_txn, None
        self.kept: dict[tuple, DataFrame] | None = None

    @property
    def path(self) -> str:
        return self.store.path

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: ArraySchema) -> ArrayDatabase:
        store = Store(spark, path)
        if store.exists():
            raise IoError(f"{path} exists already")
        store.mkdirs("_commits")
        store.write_new(schema.to_json(), "schema.json")
        return cls(spark, store, schema, {}, 1)

    @classmethod
    def open(cls, spark: SparkSession, path: str, lease_s: float = LEASE_S) -> ArrayDatabase:
        """Removes what was never committed, if nothing in it has changed for ``lease_s``: its writer may be alive."""
        store = Store(spark, path)
        schema = ArraySchema.from_json(store.read_text("schema.json"))
        return cls(spark, store, schema, *store.recover(lease_s))

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, schema: ArraySchema) -> ArrayDatabase:
        return cls.open(spark, path) if Store(spark, path).exists() else cls.create(spark, path, schema)

    def transaction(self, horizon: int | None = None) -> Transaction:
        """Sees what was committed below ``horizon`` (by default everything so far) and its own rows."""
        return Transaction(self, self.next_txn if horizon is None else horizon)

    def as_of(self, txn: int) -> Transaction:
        """The state right after transaction ``txn``."""
        return self.transaction(txn + 1)

    def allocate(self) -> int:
        self.next_txn += 1
        return self.next_txn - 1

    def cache(self, on: bool = True) -> None:
        """Keep the rows of scanned snapshots in the executors' memory and disk (off at first); CACHED of them at most."""
        for rows in (self.kept or {}).values():
            rows.unpersist()
        self.kept = {} if on else None

    def visible(self, horizon: int) -> list[tuple[int, str, int]]:
        """Transaction, run and segment of what a snapshot reads; a compaction stands for all before it."""
        below = [m for t, m in sorted(self.commits.items()) if t < horizon]
        start = max((i for i, m in enumerate(below) if m.get("compacted")), default=0)
        return [(m["txn"], m["run"], s) for m in below[start:] for s in m["segments"]]

    def segments(self) -> DataFrame:
        """txn, seg of all committed segments."""
        return self.spark.createDataFrame([(m["txn"], s) for m in self.commits.values() for s in m["segments"]], "txn long, seg int")

    def read(self, segments: list[tuple[int, str, int]]) -> DataFrame:
        """Rows of segments with their ``_version``; missing or damaged files fail the query."""
        if self.kept is None or not segments:
            return self._scan(segments)
        key = tuple(segments)
        if key not in self.kept:
            if len(self.kept) >= CACHED:
                self.kept.pop(next(iter(self.kept))).unpersist()
            self.kept[key] = self._scan(segments).persist()
        return self.kept[key]

    def _scan(self, segments: list[tuple[int, str, int]]) -> DataFrame:
        schema = self.schema.struct_type()
        if not segments:
            return self.spark.createDataFrame([], schema.add("_version", T.LongType()))
        rows = self.spark.read.schema(schema.add("txn", T.LongType()).add("seg", T.IntegerType())).option("basePath", self.store.at("data"))
        rows = rows.parquet(*(self.store.segment(*x) for x in segments))
        return rows.select(*self.schema.names, pack_version(rows["txn"], rows["seg"]).alias("_version"))

    def compact(self) -> None:
        """Rewrite the visible rows as one segment; older snapshots still read the old ones."""
        with self.transaction() as txn:
            txn.append(txn.query(ordered=False))
            txn.commit(compacted=True)
