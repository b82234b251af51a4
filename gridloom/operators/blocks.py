"""Block operators: counts, bounds and dimension vectors of chunks, and the dense form with missing cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.schema import ArraySchema


def chunks(schema: ArraySchema) -> list[str]:
    return [f"{d}__chunk" for d in schema.dims]


def with_chunks(df: DataFrame, schema: ArraySchema) -> DataFrame:
    return df.select("*", *schema.chunk_columns())


def chunk_counts(df: DataFrame, schema: ArraySchema) -> DataFrame:
    return with_chunks(df, schema).groupBy(*chunks(schema)).agg(F.count(F.lit(1)).alias("n_rows"))


def block_bounds(df: DataFrame, schema: ArraySchema) -> DataFrame:
    """Rows and least and largest key of each chunk."""
    ends = [f(d).alias(f"{n}_{d}") for d in schema.dims for n, f in (("min", F.min), ("max", F.max))]
    return with_chunks(df, schema).groupBy(*chunks(schema)).agg(F.count(F.lit(1)).alias("n_rows"), *ends)


def dimension_vectors(df: DataFrame, schema: ArraySchema) -> DataFrame:
    """Each chunk's sorted distinct values in each dimension; a chunk bounds their number by its size."""
    return with_chunks(df, schema).groupBy(*chunks(schema)).agg(*(F.array_sort(F.collect_set(d)).alias(f"{d}_vector") for d in schema.dims))


def block_density(df: DataFrame, schema: ArraySchema) -> DataFrame:
    """Cells of each chunk's dense form, and how many are present and missing."""
    sizes = with_chunks(df, schema).groupBy(*chunks(schema)).agg(F.count_distinct(*schema.dims).alias("present"), *(F.count_distinct(d).alias(f"_{d}") for d in schema.dims))
    cells = reduce(lambda a, b: a * b, (F.col(f"_{d}") for d in schema.dims))
    return sizes.select(*chunks(schema), cells.alias("cells"), "present", (cells - F.col("present")).alias("missing"))


def densify(df: DataFrame, schema: ArraySchema) -> DataFrame:
    """All cells of each chunk's dense form; missing ones have null values.

    A cell is a combination of the chunk's own dimension values, so a chunk gives (product of its chunk sizes)
    cells at most.
    """
    cells = dimension_vectors(df, schema)
    for d in schema.dims:
        cells = cells.withColumn(d, F.explode(f"{d}_vector"))
    return cells.select(*chunks(schema), *schema.dims).join(df.select(*schema.names), schema.dims, "left").select(*chunks(schema), *schema.names)


def sparsify(dense: DataFrame, schema: ArraySchema) -> DataFrame:
    """The present cells of a dense form, as rows."""
    return dense.where(F.col(schema.vals[0]).isNotNull()).select(*schema.names)
