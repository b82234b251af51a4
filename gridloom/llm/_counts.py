"""Counts over all texts in a fixed number of cells, summed on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import shuffle_partitions

PARTS = 16


def summed_cells(df: DataFrame, cells: int, counter) -> "numpy.ndarray":  # noqa: F821
    """Sum over all batches of ``counter(batch)``, an array of ``cells`` counts.

    Each task adds up its batches and sends PARTS compressed ranges of cells; the ranges are summed apart, first in as
    many groups of tasks as the shuffle partitions allow, then over the groups. So no task reads what all tasks send,
    and the driver gets ``cells`` numbers, whatever the input's size.
    """
    import numpy as np
    import zstandard

    width = -(-cells // PARTS)

    def count(batches):
        total = np.zeros(width * PARTS, np.int64)
        for batch in batches:
            if batch.num_rows:
                total[:cells] += counter(batch)
        if total.any():
            yield sums({part: x for part, x in enumerate(total.reshape(PARTS, width))})

    def sums(totals):
        import pyarrow as pa

        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.RecordBatch.from_pydict({"part": pa.array(totals, pa.int32()), "counts": pa.array([pack(x.tobytes()) for x in totals.values()], pa.binary())})

    def add(batches):
        totals: dict = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int64)
                totals[part] = totals.get(part, 0) + found
        if totals:
            yield sums(totals)

    schema = "part int, counts binary"
    groups = max(1, shuffle_partitions(df.sparkSession) // PARTS)
    sent = df.mapInArrow(count, schema).withColumn("group", F.spark_partition_id() % groups)
    grouped = sent.repartition(PARTS * groups, "part", "group").select("part", "counts").mapInArrow(add, schema)
    out = np.zeros((PARTS, width), np.int64)
    for row in grouped.repartition(PARTS, "part").mapInArrow(add, schema).collect():
        out[row["part"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["counts"]), np.int64)
    return out.ravel()[:cells]
