"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so, and becomes the ordered list of its chunks' identifiers (its
recipe). Equal texts have equal recipes and the other way round, so documents are compared by these short
lists; the text itself moves once, to verify that a chunk identifier stands for one content.

Defined results: a null text counts as empty; texts are compared byte by byte with no normalisation; of equal
texts the row with the largest doc_id stays (a null doc_id is smallest), and of repeated rows with equal doc_id
and equal text exactly one. An empty table gives an empty result; further columns are ignored by ``exact_groups``
and kept by ``drop_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._common import table, written

#: A chunk ends after a sentence end that is followed by a letter of the first third of the alphabet, 128
#: characters after its start at the earliest, 4096 at the latest.
CHUNK = r"(?s).{128,4096}?(?:[.!?\n]\s?[A-HÀ-Ï]|\z)|.{1,4096}"


def chunks_of(text: Column) -> Column:
    """Ordered chunks; joined they are the text. Bytes that are no UTF-8 are cut as hexadecimal text."""
    readable = F.when(F.is_valid_utf8(text), text).otherwise(F.hex(text.cast("binary")))
    return F.regexp_extract_all(readable, F.lit(CHUNK), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(docs: DataFrame, hashed=chunk_hash) -> DataFrame:
    """_row, doc_id, text_sha256 and the recipe: text length (negative if not UTF-8), then verified chunk identifiers.

    A chunk's identifier is its hash if all chunks of that hash are equal, which is verified on the chunks
    themselves. Contents that share a hash are told apart by a second number, their rank among these contents.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    length = F.when(F.is_valid_utf8("text"), F.octet_length("text")).otherwise(-F.octet_length("text")).cast("long")
    cut = base.withColumn("chunks", chunks_of(F.col("text")))
    rows = written(
        cut.select(
            F.monotonically_increasing_id().alias("_row"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
            F.concat(F.array(length), F.transform("chunks", hashed)).alias("recipe"),
        ),
        "recipes",
    )
    contents = cut.select(F.explode("chunks").alias("chunk")).select(hashed(F.col("chunk")).alias("hash"), "chunk").distinct()
    shared = written(contents.groupBy("hash").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("hash"), "chunk-collisions")
    if shared.isEmpty():
        return rows
    # Contents that share a hash, which is rare, get their rank; only documents that hold one are looked at again.
    ranked = contents.join(shared, "hash").select("hash", "chunk", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")).cast("long").alias("rank"))
    places = (
        cut.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.posexplode("chunks").alias("place", "chunk"))
        .withColumn("hash", hashed(F.col("chunk")))
        .join(ranked, ["hash", "chunk"])
        .select("text_sha256", "place", "rank")
        .distinct()
        .groupBy("text_sha256")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "rank"))), lambda x: F.array(x["place"], x["rank"]))).alias("ranks"))
    )
    return rows.join(places, "text_sha256", "left").withColumn("recipe", F.concat("recipe", F.coalesce("ranks", F.array().cast("array<bigint>")))).drop("ranks")


def exact_groups(docs: DataFrame, hashed=chunk_hash) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = recipes(docs, hashed).withColumn("_key", F.xxhash64("recipe"))
    # A group may hold a third of all rows. Its aggregate is written, so that the join has exchanges of its own, whose
    # large partitions adaptive execution can split.
    groups = written(rows.groupBy("_key", "recipe").agg(F.max(F.struct("doc_id", "_row")).alias("_kept"), F.count(F.lit(1)).alias("group_size")), "recipe-groups")
    return rows.join(groups, ["_key", "recipe"]).select(
        "doc_id", F.col("_kept.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_kept._row")).alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = written(exact_groups(docs), "exact-groups")
    gone = found.where(~F.col("kept") & ~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    left = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (sha == F.col("_sha")), "left_anti")
    if found.where(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).isEmpty():
        return left
    # Rows that repeat doc_id and text: one of them stays.
    return left.withColumn("_sha", sha).dropDuplicates(["doc_id", "_sha"]).drop("_sha")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
