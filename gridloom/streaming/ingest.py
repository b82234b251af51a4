"""Streams into an array database: one transaction for each micro-batch, once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.database import ArrayDatabase


def array_sink(path: str, source: str = "stream", seq: str | None = None):
    """A function for ``foreachBatch``. A batch that was committed before is skipped, so retries add nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        db = ArrayDatabase.open(batch.sparkSession, path)
        if any(m.get("source") == source and m.get("batch", -1) >= batch_id for m in db.commits.values()):
            return
        with db.transaction() as txn:
            txn.append(batch, seq)
            txn.extra |= {"source": source, "batch": batch_id}
            txn.commit()

    return write
