"""Dictionary encoding of key columns by ids that are given in sort order and never change."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.errors import DataError

#: A dictionary is broadcast up to so many entries; a larger one is joined by its keys.
BROADCAST_ENTRIES = 200_000


def empty(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([], ", ".join(["id long", *(f"{k} string" for k in keys)]))


def _same(keys: list[str]) -> Column:
    """Keys are equal, nulls too."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))


def extend(dictionary: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The dictionary with the new keys of ``rows``, numbered by sort order from the largest id + 1."""
    new = rows.select(*keys).distinct()
    new = new.join(dictionary.select(*(F.col(k).alias(f"_{k}") for k in keys)), _same(keys), "left_anti")
    most = dictionary.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_most"))
    numbered = new.crossJoin(F.broadcast(most)).select((F.col("_most") + F.row_number().over(Window.orderBy(*keys))).cast("long").alias("id"), *keys)
    return dictionary.select("id", *keys).unionByName(numbered)


def encode(rows: DataFrame, dictionary: DataFrame, keys: list[str], name: str = "id", entries: int | None = None) -> DataFrame:
    """``rows`` with the id in place of the keys. ``entries``: how many the dictionary has, if known."""
    ids = dictionary.select(F.col("id").alias(name), *(F.col(k).alias(f"_{k}") for k in keys))
    joined = rows.join(F.broadcast(ids) if entries is not None and entries <= BROADCAST_ENTRIES else ids, _same(keys))
    return joined.drop(*keys, *(f"_{k}" for k in keys))


def to_json(dictionary: DataFrame) -> str:
    return json.dumps([r.asDict() for r in dictionary.orderBy("id").collect()], indent=2)


def from_json(spark: SparkSession, text: str, keys: list[str]) -> DataFrame:
    try:
        rows = [(int(r["id"]), *(r[k] for k in keys)) for r in json.loads(text)]
    except (ValueError, KeyError, TypeError) as e:
        raise DataError(f"the dictionary can't be read: {e}") from e
    return spark.createDataFrame(rows, ", ".join(["id long", *(f"{k} string" for k in keys)])) if rows else empty(spark, keys)
