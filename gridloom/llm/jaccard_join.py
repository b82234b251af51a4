"""N-gram Jaccard join with prefix filters under several global token orders.

Tokens are five-word shingles (64-bit hashes). A global order puts rare tokens first; if two sets reach the threshold,
they share a token of their prefixes under every such order, the prefix being the first n - ceil(0.8 n) + 1 tokens.
So the sets that meet in the index of the first order's prefixes are candidates only if they also share a prefix token
under each other order; that is found from the prefixes alone, and texts move for the pairs that are left, which are
compared in full.

Frequency: all tokens of all documents are counted, at any size of the corpus. A token's key has as many bits as
numbers all tokens, and SPARE more; blocks of texts send their distinct keys, packed, to the part that counts them,
and get back a level for each. Tokens that no other class holds come first in every order. A set whose prefix has no
other tokens can have no link and goes no further; of the others these tokens are left out of the index. The orders
differ in what they call equally rare, and order equally rare tokens by hashes of their own. Keys that two tokens
share by chance make an order coarser, never a result wrong.

Skew: documents with equal sets are one class, named by 128 bits, and enter once. The candidates are taken in three
rounds. In the first two each class is compared with the hubs it meets only (each token has one hub, the most central
set that holds it), so a group of near copies costs about as many comparisons as it has members, not its square. In
the third, pairs that share a prefix token at places that leave room for the overlap they need, and that are not yet in
one component, are compared (``in_bands`` has which sets of a token meet); since links inside a component add
nothing to it, no component is missed. What joins with hot keys read is written before, so that their partitions can
be split. The result is the components; pairs inside a component are not all verified. ``jaccard_links`` verifies all pairs.

Defined results: A-Z is lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; a text of one to four words is one shingle;
a text without words has no shingles and is linked with nothing; a null doc_id is no member's name, but its text
links others; rows that repeat a doc_id stand for themselves; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import WORD, forget, shuffle_partitions, table, written
from gridloom.llm._shingles import DENOMINATOR, NUMERATOR, PART_TOKENS, SPARE, packed, prefixes, shingle_sets, token_levels
from gridloom.llm.components import components

#: Cells of the sieve that keeps what nobody asks for out of a shuffle: the most rows it broadcasts.
SIEVE = 1 << 20


#: The first token that two sets share has no more shared tokens after it than the shorter rest holds, and that must do
#: for the overlap they need.
ENOUGH = f"least(rest_a, rest_b) * {NUMERATOR + DENOMINATOR} >= (n_a + n_b) * {NUMERATOR}"


def linked(a, b) -> bool:
    import numpy as np

    if len(a) * DENOMINATOR < len(b) * NUMERATOR or len(b) * DENOMINATOR < len(a) * NUMERATOR or not len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def sieved(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``; by hash cells, so a join with ``wanted`` must follow."""
    cell = F.pmod(F.xxhash64(key), F.lit(SIEVE))
    return rows.join(F.broadcast(wanted.select(cell.alias("_cell")).distinct()), cell == F.col("_cell"), "left_semi")


def key_bits(tokens: int, partitions: int) -> tuple[int, int]:
    """Bits of a token's key, and how many of them number the parts that count; both grow with the tokens."""
    bits = min(63, max(24, tokens.bit_length() + SPARE))
    return bits, min(bits - 1, max(4 * partitions, tokens // PART_TOKENS, 2).bit_length())


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: classes) that share a prefix token under the other orders too; no text is read."""
    of_a, of_b = (sieved(classes.select(F.col("cid").alias(x), F.col("k2").alias(f"k2_{x}"), F.col("k3").alias(f"k3_{x}")), x, pairs) for x in "ab")
    both = pairs.join(of_a, "a").join(of_b, "b")
    return both.where(F.arrays_overlap("k2_a", "k2_b") & F.arrays_overlap("k3_a", "k3_b")).select("a", "b")


def compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: classes) that reach the threshold. A hub's text may be wanted by most rows; its join can be split."""
    of_a, of_b = (sieved(classes.select(F.col("cid").alias(x), F.col("text").alias(f"text_{x}")), x, pairs) for x in "ab")
    with_b = pairs.join(of_a, "a").join(of_b, "b")

    def compare(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                a, b, texts_a, texts_b = (c.to_pylist() for c in batch.columns)
                distinct = {t: i for i, t in enumerate(dict.fromkeys(texts_a + texts_b))}
                sets = shingle_sets(list(distinct))
                found = [(x, y) for x, y, s, t in zip(a, b, texts_a, texts_b, strict=True) if linked(sets[distinct[s]], sets[distinct[t]])]
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def in_bands(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` as the larger set of a pair and as the smaller one, by key and ``meet``: what meets has both in common.

    The larger set has at most 5/4 as many tokens as the smaller, and the smaller has 8/9 of its tokens or more from the
    key's place on, as the overlap is at least 4/9 of both sizes. So of a key's sets only such meet, by bands of sizes:
    two sets that hold a common passage and a good deal else each are no pair.

    Of a key's band one component leads, the one with most sets there, and its sets meet only those that are not in it
    (meet 1: a larger set leads, 2: a smaller one does, 0: neither). So a group of near copies in one component, beside
    few sets that are not, costs its number times theirs and not its square; at most thrice as many sets meet as there
    are pairs in different components.
    """
    band = lambda n: F.floor(F.log(n) / math.log(1.25))  # noqa: E731  (it never falls as n grows)
    a, b = (members.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "rest")), "component") for x in "ab")
    a = a.withColumn("band", band(F.col("n_a")))
    b = b.where(F.col("rest_b") * (NUMERATOR + DENOMINATOR) >= F.col("n_b") * 2 * NUMERATOR)
    b = b.withColumn("band", F.explode(F.sequence(band(F.col("n_b")), band(F.floor(F.col("n_b") * DENOMINATOR / NUMERATOR)))))
    sets = a.select("key", "band", "component").unionByName(b.select("key", "band", "component"))
    sets = sets.groupBy("key", "band", "component").agg(F.count(F.lit(1)).alias("sets"))
    leads = sets.groupBy("key", "band").agg(F.max(F.struct("sets", "component"))["component"].alias("lead"), F.count(F.lit(1)).alias("components"))
    leads = written(leads.where("components > 1").drop("components"), "jaccard-leads")
    meet = lambda own, others: F.explode(F.when(F.col("component") == F.col("lead"), F.array(F.lit(own))).otherwise(F.array(F.lit(0), F.lit(others))))
    a, b = (side.join(leads, ["key", "band"]).withColumn("meet", meet(*codes)).drop("lead") for side, codes in ((a, (1, 2)), (b, (2, 1))))
    return a.withColumnRenamed("component", "component_a"), b.withColumnRenamed("component", "component_b")


def within_reach(members: DataFrame) -> DataFrame:
    """Pairs (a, b: classes) of ``members`` (key, cls, n, rest, component) that share a key, lie in different components
    and have places of that key that leave room for the overlap they need; once each."""
    a, b = in_bands(members)
    larger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("cls_a") < F.col("cls_b")))
    pairs = a.join(b, ["key", "band", "meet"]).where(larger & (F.col("component_a") != F.col("component_b"))).where(ENOUGH)
    return pairs.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()


def indexed_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n, cls, check), names (cls, check, cid, doc_id: the least of each class) and the classes
    that can have links, with their prefixes (see ``prefixes``)."""
    spark = docs.sparkSession
    both = written(packed(docs), "jaccard-packs")
    rows, packs = both.where("pack is null").select("doc_id", "text_hash", "n", "cls", "check", "uid", "block"), both.where("pack is not null").select("block", "pack")
    names = written(rows.where("n > 0").groupBy("cls", "check").agg(F.min("uid").alias("cid"), F.min("block").alias("block"), F.min("doc_id").alias("doc_id"), F.min("n").alias("n")), "jaccard-names")
    bits, part_bits = key_bits(int(rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), shuffle_partitions(spark))
    levels = written(token_levels(packs, bits, part_bits), "jaccard-levels")
    classes = written(prefixes(packs, levels, names.select("block", "cid"), bits), "jaccard-prefixes")
    forget(levels)
    rows = written(rows.select("doc_id", "text_hash", "n", "cls", "check"), "jaccard-rows")
    forget(both)
    return rows, names, classes


def meeting(classes: DataFrame) -> DataFrame:
    """key, cls, n, place: the prefix tokens, under the first order, that two classes or more hold."""
    keys = classes.select("cid", "n", "singles", F.posexplode("k1").alias("at", "key")).select("key", F.col("cid").alias("cls"), "n", (F.col("singles") + F.col("at")).alias("place"))
    met = written(keys.groupBy("key").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least < most").select("key"), "jaccard-met")
    return written(keys.join(met, "key"), "jaccard-members")


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links, as pairs between classes of equal sets, and what is in the classes.

    (a, b): pairs of classes that reach the threshold, once each, a < b; and (doc_id, text_hash, n_shingles, class): a row
    for each row of ``docs``, with a null class for a text without words. All members of a class are linked with each
    other and with those of the classes theirs is linked with. In a large group of near copies that differ all pairs are
    links, so their number can grow with its square; ``jaccard_components`` avoids that.
    """
    rows, names, classes = indexed_classes(docs)
    members = meeting(classes).withColumn("rest", F.col("n") - F.col("place")).withColumn("component", F.col("cls"))
    pairs = written(agreeing(written(within_reach(members), "jaccard-reach"), classes), "jaccard-agreeing")
    links = compared(pairs, classes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    of = rows.join(names.select("cls", "check", F.col("cid").alias("class")), ["cls", "check"], "left")
    return written(links, "jaccard-links"), written(of.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "class"), "jaccard-of")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, component and text_hash for each row of ``docs``; component is null for a text without words."""
    rows, names, classes = indexed_classes(docs)
    members = meeting(classes)

    # The more of a set's prefix others hold too, the more central it is: the original among its altered copies.
    most = F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1
    central = members.groupBy("cls", "n").agg(F.count(F.lit(1)).alias("held")).select("cls", (-F.round(F.col("held") * 1000 / most)).cast("int").alias("outer"))
    hubs = members.join(central, "cls").groupBy("key").agg(F.min(F.struct("outer", "cls", "n", "place")).alias("hub"))
    hubs = written(hubs.select("key", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("n_b"), (F.col("hub.n") - F.col("hub.place")).alias("rest_b")), "jaccard-hubs")
    met_hubs = members.select("key", "cls", F.col("n").alias("n_a"), (F.col("n") - F.col("place")).alias("rest_a")).join(hubs, "key")
    votes = written(met_hubs.where(F.col("cls") != F.col("hub")).where(ENOUGH).groupBy("cls", "hub").agg(F.count(F.lit(1)).alias("votes")), "jaccard-votes")

    # First each class with the hub it meets most, then with its other hubs, then with all it meets, each time only
    # across components.
    first = votes.groupBy("cls").agg(F.max(F.struct("votes", "hub"))["hub"].alias("b")).select(F.col("cls").alias("a"), "b")
    known = written(first, "jaccard-first")
    links = written(compared(written(agreeing(known, classes), "jaccard-agreeing"), classes), "jaccard-links")
    of = written(components(links), "jaccard-components")
    for step in ("hubs", "all"):
        label = of.select(F.col("node").alias("cls"), "component")
        if step == "hubs":
            pairs = votes.select(F.col("cls").alias("a"), F.col("hub").alias("b"))
            for x in "ab":
                pairs = pairs.join(label.select(F.col("cls").alias(x), F.col("component").alias(f"c_{x}")), x, "left")
            pairs = pairs.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
        else:
            placed = written(members.join(label, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "jaccard-placed")
            open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
            left = written(placed.join(written(open_keys, "jaccard-open-keys"), "key"), "jaccard-open")
            pairs = within_reach(left.withColumn("rest", F.col("n") - F.col("place")))
        either = known.select("a", "b").unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = written(pairs.join(either, ["a", "b"], "left_anti"), f"jaccard-{step}")
        known = known.unionByName(pairs)
        if pairs.isEmpty():
            continue
        more = written(compared(written(agreeing(pairs, classes), f"jaccard-agreeing-{step}"), classes), f"jaccard-links-{step}")
        if not more.isEmpty():
            links = links.unionByName(more)
            of = written(components(links), "jaccard-components")

    # A component may hold a third of all classes, a class a third of all rows; each side of these joins is written, so
    # that large partitions can be split.
    grouped = written(names.join(of.withColumnRenamed("node", "cid"), "cid", "left").select("cls", "check", "doc_id", F.coalesce("component", "cid").alias("component")), "jaccard-grouped")
    ids = written(grouped.groupBy("component").agg(F.min("doc_id").alias("component_id")), "jaccard-ids")
    named = written(grouped.join(ids, "component").select("cls", "check", "component_id", "component"), "jaccard-named")
    named = rows.withColumnRenamed("n", "n_shingles").join(named, ["cls", "check"], "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component", "text_hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, the first by doc_id (nulls last) and text hash, and all rows without words; all columns."""
    found = written(jaccard_components(docs).where("component is not null").select("component", "doc_id", "text_hash"), "jaccard-found")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("rows"))
    first = written(first.where("rows > 1").select("component", "first.doc_id", "first.text_hash"), "jaccard-stay")
    # A component may hold a third of all rows; its first row is written, so that large partitions of the join can be split.
    both = found.join(first.select("component", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "component")
    stays = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    gone = both.where(~stays).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (text_hash == gone["_hash"]), "left_anti")
    if both.where(stays).groupBy("component").count().where("count > 1").isEmpty():
        return left
    # Rows that repeat doc_id and text: one of them stays, but of those without words all do.
    apart = F.when(~F.coalesce("text", F.lit("")).rlike(WORD), F.monotonically_increasing_id())
    return left.withColumn("_text_hash", text_hash).withColumn("_apart", apart).dropDuplicates(["doc_id", "_text_hash", "_apart"]).drop("_text_hash", "_apart")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
