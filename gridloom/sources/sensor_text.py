"""Tab-separated sensor logs: lines, fields, good and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gridloom.errors import IoError
from gridloom.functions.parse import fixed_point, time_millis

FIELDS = ["time", "component", "sensor", "kind", "value"]


def read_lines(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Lines of files by wildcard, plain or .gz; only line feeds end a line, leading NULs are dropped."""
    try:
        lines = spark.read.option("lineSep", "\n").text(patterns)
    except AnalysisException as e:
        raise IoError(f"no file matches {patterns}") from e
    return lines.select(F.regexp_replace("value", "^\\x00+", "").alias("line"))


def once(rows: DataFrame, *kept: str, **made: Column) -> DataFrame:
    """``kept`` columns and ``made`` ones, which are computed once a row: filters would else move below them and repeat
    their expressions, and theirs again, at every use."""
    values = F.array(F.struct(*(c.alias(name) for name, c in made.items())))
    return rows.select(*kept, F.inline(values))


def split_fields(lines: DataFrame, *others: str) -> DataFrame:
    """The line with its five fields, or nulls, and ``others`` of the columns."""
    lines = once(lines, *others, line=F.col("line"))
    lines = once(lines, "line", *others, _parts=F.split("line", "\t", -1))
    fits = F.size("_parts") == len(FIELDS)
    return lines.select("line", *(F.when(fits, F.col("_parts")[i]).alias(f) for i, f in enumerate(FIELDS)), *others)


def parse(lines: DataFrame, *others: str) -> DataFrame:
    """line, time_ms, component, sensor, kind, value_milli, ``others`` of the columns, ok. Blank lines and others that don't fit are not ok."""
    fields = once(split_fields(lines, *others), "line", "component", "sensor", "kind", *others, time_ms=time_millis(F.col("time")), value_milli=fixed_point(F.col("value")))
    parsed = fields.select("line", "time_ms", "component", "sensor", "kind", "value_milli", *others)
    return parsed.withColumn("ok", F.col("time_ms").isNotNull() & (F.col("time_ms") >= 0) & F.col("value_milli").isNotNull())


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where("ok").drop("line", "ok")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("not ok").select("line")
