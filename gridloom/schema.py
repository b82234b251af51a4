"""Array schemas: ordered dimensions (key columns with a chunk size) and ordered values."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import IoError, SchemaError


@dataclass(frozen=True)
class Dimension:
    name: str
    chunk_size: int


@dataclass(frozen=True)
class Value:
    name: str


@dataclass(frozen=True)
class ArraySchema:
    dimensions: tuple[Dimension, ...]
    values: tuple[Value, ...]

    def __init__(self, dimensions, values):
        object.__setattr__(self, "dimensions", tuple(d if isinstance(d, Dimension) else Dimension(*d) for d in dimensions))
        object.__setattr__(self, "values", tuple(v if isinstance(v, Value) else Value(v) for v in values))
        names = self.names
        if not self.dimensions or not self.values:
            raise SchemaError("an array has one dimension and one value at least")
        if len(set(names)) != len(names) or any(not n or n.startswith("_") for n in names):
            raise SchemaError(f"names must differ and not begin with an underscore: {names}")
        if any(not isinstance(d.chunk_size, int) or d.chunk_size < 1 for d in self.dimensions):
            raise SchemaError("a chunk size is 1 at least")

    @property
    def dims(self) -> list[str]:
        return [d.name for d in self.dimensions]

    @property
    def vals(self) -> list[str]:
        return [v.name for v in self.values]

    @property
    def names(self) -> list[str]:
        return self.dims + self.vals

    def struct_type(self) -> T.StructType:
        dims = [T.StructField(d.name, T.LongType(), False, {"role": "dimension", "chunk_size": d.chunk_size}) for d in self.dimensions]
        return T.StructType(dims + [T.StructField(v.name, T.LongType(), False, {"role": "value"}) for v in self.values])

    def chunk_columns(self) -> list[Column]:
        return [F.expr(f"`{d.name}` div {d.chunk_size}L").alias(f"{d.name}__chunk") for d in self.dimensions]

    def to_json(self) -> str:
        whole = {"dimensions": [{"name": d.name, "chunk_size": d.chunk_size} for d in self.dimensions], "values": [{"name": v.name} for v in self.values]}
        return json.dumps(whole, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> ArraySchema:
        try:
            whole = json.loads(text)
            return cls([(d["name"], d["chunk_size"]) for d in whole["dimensions"]], [v["name"] for v in whole["values"]])
        except (ValueError, KeyError, TypeError) as e:
            raise IoError(f"the schema can't be read: {e}") from e
