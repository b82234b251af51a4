"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share the total; a target stops
at 3 times its source's size and the excess is reshared by weight (the water level is solved in closed form).

Each source's documents are put in a keyed hash order on one line of words, which is cut into blocks of equal
length. Slot k of the schedule takes the golden-ratio point k * phi mod 1, looked up in the sources' cumulative
weights; the r-th slot of a source takes its r-th block, round after round. A source's slots are held to its
exact quota: points beyond it are left out, and the few that a low-discrepancy sequence is short of stand at the
end. Quotas never exceed three rounds, so no document is taken more than three times.

Defined results: a null text has no words; a document without words is never taken; a null source is a source
of its own; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._common import WORD, shuffle_partitions, table, written

WEIGHTS, CAP = (5, 2, 1), 3
#: Words in a block; a small source has shorter blocks, so that it has MIN_BLOCKS of them (or one for each word).
BLOCK_WORDS, MIN_BLOCKS = 512, 1024
SEED = 11
BITS, HALF = 52, 26
GOLDEN = 0x9E3779B97F4A7  # 2^52 / golden ratio, odd: a fixed value
PHI_HIGH, PHI_LOW = GOLDEN >> HALF, GOLDEN & ((1 << HALF) - 1)


@dataclass
class Mixture:
    plan: DataFrame  # sid, source, source_size, docs, weight, target, block_words, blocks, quota, low, high
    lines: DataFrame  # sid, doc_id, text_hash, size, start
    schedule: DataFrame  # slot, sid, rank, round, block
    spans: DataFrame  # slot, sid, doc_id, start, size, words: what each slot takes of each document


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def golden_point(k: Column) -> Column:
    """k * GOLDEN mod 2^52 without overflow."""
    mask = F.lit((1 << HALF) - 1)
    high, low = F.shiftright(k, HALF).bitwiseAND(mask), k.bitwiseAND(mask)
    cross = (high * F.lit(PHI_LOW) + low * F.lit(PHI_HIGH)).bitwiseAND(mask)
    return (low * F.lit(PHI_LOW) + F.shiftleft(cross, HALF)).bitwiseAND(F.lit((1 << BITS) - 1))


def source_plan(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each source: its target, blocks, quota of slots and interval of points. Sources are few against rows."""
    every = Window.partitionBy()
    by_source = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", "sid")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))) + 1)
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    # Taking the sources up to some ratio as full and the others as free bounds what a level shares out from above,
    # so each such guess is the level or below it, and the level is the largest.
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    found = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
        .withColumn("sid", F.row_number().over(by_source))
        .withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("cap", CAP * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(every))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
        .withColumn("block_words", F.ceil(F.col("source_size") / F.greatest(F.ceil(F.col("source_size") / block_words), F.least("source_size", F.lit(MIN_BLOCKS)), F.lit(1))))
        .withColumn("blocks", F.when(F.col("source_size") > 0, F.ceil(F.col("source_size") / F.col("block_words"))).otherwise(0))
        .withColumn("quota", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"), CAP * F.col("blocks"))).otherwise(0))
    )
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    edge = lambda share: F.floor(share * F.lit(float(1 << BITS))).cast("long")
    return (
        found.withColumn("_upto", F.sum("quota").over(upto))
        .withColumn("slots", F.sum("quota").over(every))
        .withColumn("low", F.when(F.col("slots") > 0, edge((F.col("_upto") - F.col("quota")) / F.col("slots"))).otherwise(0))
        .withColumn("high", F.when(F.col("slots") > 0, edge(F.col("_upto") / F.col("slots"))).otherwise(0))
        .select("sid", "source", "source_size", "docs", "weight", "target", "block_words", "blocks", "quota", "low", "high", "slots")
    )


def document_lines(sizes: DataFrame, plan: DataFrame, rows: int, seed: int = SEED) -> DataFrame:
    """Each document's start on its source's line of words; documents stand in a keyed hash order.

    Prefix sums in two levels of about sqrt(rows) each, so that a source with most of the rows is never in one task.
    """
    groups = max(1, math.isqrt(rows))
    keyed = (
        sizes.join(plan.select("sid", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "size", "text_hash"))
        .withColumn("_group", F.pmod("_hash", F.lit(groups)))
        .select("sid", "doc_id", "size", "text_hash", "_group", "_hash")
    )
    before = Window.partitionBy("sid").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy("sid", "_group").agg(F.sum("size").alias("_words")).select("sid", "_group", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("sid", "_group").orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(bases, ["sid", "_group"])
        .select("sid", "doc_id", "text_hash", "size", (F.col("_base") + F.col("_inside")).alias("start"))
    )


def slot_schedule(spark: SparkSession, plan: DataFrame, slots: int) -> DataFrame:
    """slot, sid, rank, round, block: the golden-ratio schedule, each source held to its quota."""
    shift = BITS - max(12, (4 * shuffle_partitions(spark)).bit_length())
    cells = plan.where("quota > 0 and high > low").select(
        "sid", "low", "high", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("cell")
    )
    chunk = max(1, math.isqrt(slots))
    points = (
        spark.range(slots)
        .select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
        .withColumn("cell", F.shiftright("point", shift))
        .join(cells, "cell")
        .where("low <= point and point < high")
        .select("slot", "sid", F.call_function("div", F.col("slot"), F.lit(chunk).cast("long")).alias("chunk"))
    )
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = points.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    bases = counts.select("sid", "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("sid", "chunk").orderBy("slot")
    ranked = points.withColumn("_inside", F.row_number().over(inside)).join(bases, ["sid", "chunk"]).select("slot", "sid", (F.col("_base") + F.col("_inside") - 1).alias("rank"))
    have = counts.groupBy("sid").agg(F.sum("_n").alias("_have"))
    short = (
        plan.join(have, "sid", "left")
        .withColumn("_have", F.coalesce("_have", F.lit(0)))
        .where("_have < quota")
        .select("sid", "quota", F.explode(F.sequence(F.col("_have"), F.col("quota") - 1)).alias("rank"))
        .select((F.lit(slots) + F.row_number().over(Window.orderBy(F.col("rank") / F.col("quota"), "sid")) - 1).cast("long").alias("slot"), "sid", "rank")
    )
    turn = F.call_function("div", F.col("rank"), F.col("blocks"))
    return (
        ranked.unionByName(short)
        .join(plan.select("sid", "quota", "blocks"), "sid")
        .where("rank < quota")
        .withColumn("round", turn)
        .withColumn("block", F.pmod(F.col("rank") + F.col("round") * F.call_function("div", F.col("blocks"), F.lit(3).cast("long")), F.col("blocks")))
        .select("slot", "sid", "rank", "round", "block")
    )


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> Mixture:
    spark = docs.sparkSession
    sizes = written(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")), "mix-sizes")
    plan = written(source_plan(sizes, block_words), "mix-plan")
    slots, rows = (plan.agg(F.coalesce(F.max("slots"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first() or (0, 0))
    lines = written(document_lines(sizes, plan, rows, seed), "mix-lines")
    schedule = slot_schedule(spark, plan, slots)
    first = lambda at: F.call_function("div", at, F.col("block_words"))
    laid = (
        lines.where("size > 0")
        .join(plan.select("sid", "block_words"), "sid")
        .withColumn("block", F.explode(F.sequence(first(F.col("start")), first(F.col("start") + F.col("size") - 1))))
        .withColumn("words", F.least((F.col("block") + 1) * F.col("block_words"), F.col("start") + F.col("size")) - F.greatest(F.col("block") * F.col("block_words"), F.col("start")))
        .select("sid", "block", "doc_id", "text_hash", "start", "size", "words")
    )
    return Mixture(plan, lines, schedule, schedule.join(laid, ["sid", "block"]))


def taken_words(mixture: Mixture) -> DataFrame:
    """One row for each document: what the mixture takes of it."""
    taken = mixture.spans.groupBy("sid", "start", "size", "doc_id").agg(F.sum("words").alias("taken"))
    same = [F.col(f"l.{c}") == F.col(f"t.{c}") for c in ("sid", "start", "size")] + [F.col("l.doc_id").eqNullSafe(F.col("t.doc_id"))]
    return (
        mixture.lines.alias("l")
        .join(taken.alias("t"), same, "left")
        .select("l.sid", "l.doc_id", "l.text_hash", "l.start", "l.size", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))
        .join(mixture.plan.select("sid", "source_size", "target"), "sid")
    )


def taken_parts(mixture: Mixture) -> DataFrame:
    """source, doc_id, text_hash, size, parts: the runs of words (from, to) that stand in the mixture for each document taken.

    A document of at most BLOCK_WORDS words is taken as often as comes nearest; at most two documents of a source straddle
    an edge of its last round, so this is off by a block's words at most. Of a longer one the words beyond its whole
    copies are those that the slots of the last round cover. Rows that repeat source, doc_id and text share alike.
    """
    div = lambda x, y: F.call_function("div", x, y)
    turns = div(F.col("quota"), F.col("blocks"))
    # The last round's blocks follow each other from its first one, and on from the line's beginning.
    first = F.pmod(turns * div(F.col("blocks"), F.lit(3).cast("long")), F.col("blocks"))
    last = first + F.pmod("quota", F.col("blocks"))
    edges = mixture.plan.where("blocks > 0").select(
        "sid", "source", turns.alias("turns"), (first * F.col("block_words")).alias("low"), (F.least(last, F.col("blocks")) * F.col("block_words")).alias("high"),
        (F.greatest(last - F.col("blocks"), F.lit(0)) * F.col("block_words")).alias("again"),
    )
    run = lambda low, high: F.struct(low.cast("long").alias("from"), high.cast("long").alias("to"))
    inside = lambda low, high: run(F.greatest(low - F.col("start"), F.lit(0)), F.least(high - F.col("start"), F.col("size")))
    whole = lambda n: F.array_repeat(run(F.lit(0), F.col("size")), n.cast("int"))
    some = lambda runs: F.filter(runs, lambda r: r["from"] < r["to"])
    rows = (
        taken_words(mixture)
        .where("size > 0")
        .groupBy("sid", "doc_id", "text_hash", "size")
        .agg(F.count(F.lit(1)).alias("rows"), (F.sum("taken") / F.sum("size")).alias("times"), F.min("start").alias("start"))
        .join(F.broadcast(edges), "sid")
    )
    runs = F.concat(whole(F.col("turns")), some(F.array(inside(F.lit(0), F.col("again")), inside(F.col("low"), F.col("high")))))
    shared = F.concat(whole(F.floor("times")), some(F.array(run(F.lit(0), F.round((F.col("times") - F.floor("times")) * F.col("size"))))))
    parts = F.when(F.col("size") <= BLOCK_WORDS, whole(F.round("times"))).when(F.col("rows") > 1, shared).otherwise(runs)
    return rows.select("source", "doc_id", "text_hash", "size", parts.alias("parts")).where(F.size("parts") > 0)


def cut_words(text: Column, low: Column, high: Column) -> Column:
    """The words of ``text`` from ``low`` to before ``high``, with what stands between them."""
    gap = r"[\x20\x09-\x0D]"
    each = F.regexp_extract_all(text, F.lit(f"{gap}*{WORD}"), F.lit(0))
    return F.regexp_replace(F.array_join(F.slice(each, low.cast("int") + 1, (high - low).cast("int")), ""), f"^{gap}+", "")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mixture, with all columns of ``docs``: a row for each whole copy and each part of a long
    document that the mixture takes (see taken_parts). A part's row has its text and, if there is such a column, its n_chars."""
    parts = written(taken_parts(mix(docs)).withColumnsRenamed({"source": "_source", "doc_id": "_id", "text_hash": "_hash"}), "mix-parts")
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_hash"))
    is_whole = lambda r: r["to"] - r["from"] == F.col("size")
    times = parts.select("_source", "_id", "_hash", F.size(F.filter("parts", is_whole)).alias("_times")).where("_times > 0")
    rows = docs.join(times, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
    # Few documents of a source are cut; these are written, so that Spark sees their size and does not shuffle all texts for them.
    some = written(parts.select("_source", "_id", "_hash", F.explode(F.filter("parts", lambda r: ~is_whole(r))).alias("_part")), "mix-cuts")
    cut = docs.join(some, same).withColumn("text", cut_words(F.col("text"), F.col("_part.from"), F.col("_part.to")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.unionByName(cut.select(*docs.columns))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")
