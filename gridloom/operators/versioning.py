"""Latest version of each key (last writer wins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import DataError

#: Segments that a transaction can have; a version is txn * SEGMENTS + segment, one long.
SEGMENTS = 1 << 20


def pack_version(txn: Column, segment: Column) -> Column:
    return txn.cast("long") * F.lit(SEGMENTS) + segment.cast("long")


def check_segment(segment: int) -> None:
    if not 0 <= segment < SEGMENTS:
        raise DataError(f"a transaction has {SEGMENTS} segments at most")


def latest(df: DataFrame, dims: list[str], values: list[str], version: str, keep_version: str | None = None, parts: int | None = None) -> DataFrame:
    """One row for each key: the values of its largest version.

    Rows are brought together by key and compared in key order: most keys are written once, so hash maps would
    hold about all rows, in the tasks that read files as well. Filters on dimensions pass through to the scan.
    ``parts``: into how many parts they are brought; by default small ones are put together by their bytes.
    """
    top = df.repartition(*([parts] if parts else []), *map(F.col, dims)).groupBy(*dims).agg(F.max(F.struct(F.col(version).alias("_version"), *values)).alias("_top"))
    return top.select(*dims, *(F.col(f"_top.{v}").alias(v) for v in values), *([F.col("_top._version").alias(keep_version)] if keep_version else []))


def scan_order(df: DataFrame, dims: list[str]) -> DataFrame:
    """Key order: ascending, the first dimension most significant."""
    return df.orderBy(*dims)
