"""Sharding by a Feistel permutation with cycle walking over global row numbers, in DataFrame functions only.

Rows are numbered 0..n-1 in the order (doc_id, text_crc32, size), nulls first. The numbers are permuted by a
keyed Feistel network on the smallest rectangle a x b that holds n numbers; a number that lands outside [0, n)
walks on along its cycle. The permuted number p gives shard p mod s and slot p div s, so shards differ by one
row at most and any row's place can be computed from its number alone.

Defined results: a null text has no bytes (size 1, crc of no bytes); a null doc_id sorts first; rows equal in
doc_id and text are interchangeable; rows are permuted one by one, so equal texts are not kept together; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import numbered, table

SHARDS, SEED, ROUNDS = 8, 20_240_229, 6
PRIME = (1 << 31) - 1


class Shuffle:
    """The permutation of range(n) for a seed, in plain integers and as a Spark expression."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        assert rounds % 2 == 0, "an even number of rounds ends with the halves in place"
        self.n, self.a = n, max(1, math.isqrt(max(n, 1) - 1) + 1)
        self.b = max(1, -(-n // self.a))
        assert self.a < PRIME, "row numbers up to 2^62"
        draw = lambda i: int.from_bytes(hashlib.sha256(f"{seed}/{i}".encode()).digest()[:4], "big") % (PRIME - 1) + 1
        self.keys = [tuple(draw(4 * r + j) for j in range(4)) for r in range(rounds)]
        #: A walk leaves the numbers outside [0, n) after as many steps at most; past 64 its chance is below (1/64)^64.
        self.steps = min(self.a * self.b - n, 64)

    def once(self, x: int) -> int:
        u, v, m, k = x // self.b, x % self.b, self.a, self.b
        for k1, k2, k3, k4 in self.keys:
            t = (v * k1 + k2) % PRIME
            u, v, m, k = v, (u + (t * t % PRIME * k3 + k4) % PRIME) % m, k, m
        return u * self.b + v

    def place(self, row: int) -> int:
        x = self.once(row)
        while x >= self.n:
            x = self.once(x)
        return x

    def locate(self, row: int, shards: int = SHARDS) -> tuple[int, int]:
        """Shard and slot of a row number."""
        return self.place(row) % shards, self.place(row) // shards

    def _once(self, x: Column) -> Column:
        keys = F.array(*(F.struct(*(F.lit(k).cast("long").alias(f"k{j}") for j, k in enumerate(ks))) for ks in self.keys))
        long = lambda c: c.cast("long")
        start = F.struct(
            F.call_function("div", x, F.lit(self.b).cast("long")).alias("u"), long(x % F.lit(self.b)).alias("v"),
            long(F.lit(self.a)).alias("m"), long(F.lit(self.b)).alias("k"),
        )

        def turn(s: Column, k: Column) -> Column:
            t = (s["v"] * k["k0"] + k["k1"]) % F.lit(PRIME)
            mixed = ((t * t) % F.lit(PRIME) * k["k2"] + k["k3"]) % F.lit(PRIME)
            return F.struct(s["v"].alias("u"), long((s["u"] + mixed) % s["m"]).alias("v"), s["k"].alias("m"), s["m"].alias("k"))

        return F.aggregate(keys, start, turn, lambda s: s["u"] * F.lit(self.b) + s["v"])

    def column(self, row: Column) -> Column:
        if self.n == 0:
            return row
        first = self._once(row)
        if not self.steps:
            return first
        inside = lambda x: x < F.lit(self.n)
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(self.steps)), first, lambda x, _: F.when(inside(x), x).otherwise(self._once(x)),
            lambda x: F.when(inside(x), x).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")),
        )


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot for each row."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered(sized, ["doc_id", "text_crc32", "size"])
    n = rows.count()
    return (
        rows.withColumn("_place", Shuffle(n, seed).column(F.col("row_number")))
        .withColumn("shard", (F.col("_place") % shards).cast("int"))
        .withColumn("slot", F.expr(f"_place div {shards}"))
        .drop("_place")
    )


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
