"""Shingle sets of a corpus: where they are packed, how often each token occurs, and the sets' prefixes under several orders.

Used inside Python workers but for ``packed``, ``token_levels`` and ``prefixes``, which plan the passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERATOR, DENOMINATOR = 4, 5  # the similarity 0.8
WORDS = 5
POLY, MIX = 0x9FB21C651E98DF25, 0xBF58476D1CE4E5B9
#: Multipliers of the orders' hashes; the first order's prefixes are indexed.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Classes a task remembers so as not to pack them twice; beyond that it starts anew.
SEEN = 500_000
#: Bits of a token's key beyond those that number all tokens: one key in 2^SPARE stands for two tokens or more.
SPARE = 10
#: Tokens that one task counts at a time, about.
PART_TOKENS = 1 << 21


def shingle_sets(texts: list[bytes]) -> list:
    """Sorted distinct shingle hashes (uint64) of each text."""
    import numpy as np

    from gridloom.llm._words import hashes, joined, spread, tokens

    buf, offsets = joined(texts)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    gap = np.zeros(256, bool)
    gap[[0x20, *range(0x09, 0x0E)]] = True
    buf = lower[buf]
    starts, ends = tokens(buf, offsets, gap)
    word = hashes(buf, starts, ends)[0]
    first = np.searchsorted(starts, offsets)
    n, poly = np.diff(first), np.uint64(POLY)

    def finish(s):
        s = (s ^ (s >> np.uint64(31))) * np.uint64(MIX)
        return s ^ (s >> np.uint64(29))

    with np.errstate(over="ignore"):
        at = spread(first[:-1], np.maximum(n - WORDS + 1, 0))
        s = np.zeros(len(at), np.uint64)
        for k in range(WORDS):
            s = s * poly + word[at + k]
        s = finish(s)
        cuts = np.concatenate([[0], np.cumsum(np.maximum(n - WORDS + 1, 0))])
        out = []
        for i in range(len(texts)):
            if n[i] >= WORDS:
                out.append(np.unique(s[cuts[i] : cuts[i + 1]]))
                continue
            short = np.full(min(1, n[i]), n[i], np.uint64)
            for w in word[first[i] : first[i + 1]]:
                short = short * poly + w
            out.append(finish(short))
    return out


def class_of(tokens) -> tuple[int, int]:
    """A set's name: 128 bits, as two signed longs."""
    import xxhash

    whole = xxhash.xxh3_128_intdigest(tokens.tobytes())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(whole >> 64), signed(whole & ((1 << 64) - 1))


def prefix_size(n):
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


# -- the passes --------------------------------------------------------------------------------------------------


def packed(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, text_hash, n, cls and check (its set's name), uid (where its class is packed) and
    block; and a row for each block: block and pack, the texts of the classes that the task met there first.

    uid and block are unique and grow together within a task and from task to task.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from gridloom.llm._words import text_slices

        base = TaskContext.get().partitionId() << 33
        homes: dict[tuple[int, int], tuple[int, int]] = {}
        blocks = uids = 0
        names = ["block", "doc_id", "text_hash", "n", "cls", "check", "uid", "pack"]
        for batch in batches:
            for piece in text_slices(batch, 2):
                texts = piece.column(2).to_pylist()
                sets = shingle_sets(texts)
                marks, at, new = [class_of(s) for s in sets], [], []
                for i, mark in enumerate(marks):
                    if not len(sets[i]):
                        at.append((None, None))
                        continue
                    if mark not in homes:
                        if len(homes) > SEEN:
                            homes.clear()
                        homes[mark] = base + uids, base + blocks
                        new.append(i)
                        uids += 1
                    at.append(homes[mark])
                long, m = pa.int64(), len(texts)
                columns = [pa.array([x[1] for x in at], long), piece.column(0), piece.column(1), pa.array([len(s) for s in sets], long), *(pa.array([x[c] for x in marks], long) for c in (0, 1)), pa.array([x[0] for x in at], long), pa.nulls(m, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                if new:
                    body = pack_texts(np.array([at[i][0] for i in new]), [texts[i] for i in new])
                    yield pa.RecordBatch.from_arrays([pa.array([base + blocks], long), *(pa.nulls(1, long) for _ in range(6)), pa.array([body], pa.binary())], names=names)
                    blocks += 1

    return rows.mapInArrow(pack, "block long, doc_id long, text_hash long, n long, cls long, check long, uid long, pack binary")


def token_levels(packs: DataFrame, bits: int, part_bits: int) -> DataFrame:
    """block, part, levels: for each distinct key of a block, in order, the level of its count over all blocks.

    Each block counts its own keys first; these go to parts by their first bits as packed lists, so that a token of
    every document costs a part one count for each block.
    """

    def send(batches):
        import numpy as np
        import pyarrow as pa

        edges = np.arange(1, 1 << part_bits, dtype=np.uint64) << np.uint64(bits - part_bits)
        for batch in batches:
            for block, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = np.unique(np.concatenate(shingle_sets(unpack_texts(pack)[1])) >> np.uint64(64 - bits), return_counts=True)
                cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                parts = np.flatnonzero(np.diff(cuts))
                blobs = [pack_keys(keys[cuts[p] : cuts[p + 1]], counts[cuts[p] : cuts[p + 1]]) for p in parts]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(parts), pa.int64()), "part": pa.array(parts, pa.int32()), "keys": pa.array(blobs, pa.binary())})

    def count(key, rows):
        import numpy as np
        import pyarrow as pa

        lists = [unpack_keys(x) for x in rows.column("keys").to_pylist()]
        _, inverse = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([x[1] for x in lists])).astype(np.int64)
        levels = level_of(total)[inverse]
        ends = np.cumsum([len(x[0]) for x in lists])
        blobs = [_squeeze(levels[b - len(x[0]) : b].tobytes()) for x, b in zip(lists, ends, strict=True)]
        return pa.table({"block": rows.column("block"), "part": rows.column("part"), "levels": pa.array(blobs, pa.binary())})

    return packs.mapInArrow(send, "block long, part int, keys binary").groupBy("part").applyInArrow(count, "block long, part int, levels binary")


def prefixes(packs: DataFrame, levels: DataFrame, homes: DataFrame, bits: int) -> DataFrame:
    """cid, n, singles, k1, k2, k3, text of each class that can have a link: its prefixes under the orders without the
    tokens that no other class holds, which come first in each.

    ``homes``: block and cid of the classes, each once; copies packed by other tasks are left out here.
    """
    listed = homes.groupBy("block").agg(F.collect_list("cid").alias("cids")).select("block", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("levels"), "cids")
    sides = levels.withColumn("cids", F.lit(None).cast("array<long>")).unionByName(listed)

    def cut(pack, side):
        import numpy as np
        import pyarrow as pa

        names = ["cid", "n", "singles", "k1", "k2", "k3", "text"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        rows: list[tuple] = []
        if pack.num_rows:
            uids, texts = unpack_texts(pack.column("pack")[0].as_py())
            by_part = sorted(zip(side.column("part").to_pylist(), side.column("levels").to_pylist(), side.column("cids").to_pylist(), strict=True), key=lambda x: x[0])
            wanted = {c for p, _, cids in by_part if p < 0 for c in cids}
            level = np.frombuffer(b"".join(_unsqueeze(x) for p, x, _ in by_part if p >= 0), np.uint8)
            sets = shingle_sets(texts)
            _, inverse = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_inverse=True)
            level = level[inverse]
            ends = np.cumsum([len(s) for s in sets])
            singles = np.add.reduceat(level == 1, ends - [len(s) for s in sets])
            for i, s in enumerate(sets):
                most = prefix_size(len(s))
                if singles[i] >= most or int(uids[i]) not in wanted:
                    continue
                own = level[ends[i] - len(s) : ends[i]]
                found = [s[np.argsort(order_places(s, own, k), kind="stable")[singles[i] : most]] for k in range(len(ORDERS))]
                rows.append((int(uids[i]), len(s), int(singles[i]), found[0].view(np.int64), *(x.astype(np.uint32).view(np.int32) for x in found[1:]), texts[i]))
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)

    schema = "cid long, n int, singles int, k1 array<long>, k2 array<int>, k3 array<int>, text binary"
    return packs.groupBy("block").cogroup(sides.groupBy("block")).applyInArrow(cut, schema)


# -- formats -----------------------------------------------------------------------------------------------------


def _squeeze(body: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(body)


def _unsqueeze(body: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(body)


def pack_texts(uids, texts: list[bytes]) -> bytes:
    import numpy as np

    head = np.concatenate([[len(texts)], uids, [len(t) for t in texts]]).astype("<i8")
    return head.tobytes() + _squeeze(b"".join(texts))


def unpack_texts(pack: bytes):
    """uids and texts."""
    import numpy as np

    n = int(np.frombuffer(pack, "<i8", 1)[0])
    head, body = np.frombuffer(pack, "<i8", 2 * n, 8), _unsqueeze(pack[8 + 16 * n :])
    ends = np.cumsum(head[n:]).tolist()
    return head[:n], [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def pack_keys(keys, counts) -> bytes:
    """Sorted keys as steps, byte by byte (the high bytes are mostly 0), and their counts up to 255."""
    import numpy as np

    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return _squeeze(steps.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes())


def unpack_keys(body: bytes):
    import numpy as np

    flat = np.frombuffer(_unsqueeze(body), np.uint8).reshape(9, -1)
    return np.cumsum(np.ascontiguousarray(flat[:8].T).view("<u8").ravel(), dtype=np.uint64), flat[8]


def level_of(counts):
    """1 for a token that one class holds; counts up to 64 as they are, then four levels for each power of two."""
    import numpy as np

    high = 64 + np.floor(4 * np.log2(np.maximum(counts, 64) / 64))
    return np.where(counts <= 64, counts, np.minimum(high, 255)).astype(np.uint8)


def order_places(tokens, level, order: int):
    """Sort keys of tokens under an order. All orders begin with the tokens of one class and end with common ones, but
    differ in what they call equally rare and in how they order such tokens."""
    import numpy as np

    if order == 0:
        rank = level
    elif order == 1:
        rank = np.ceil(np.log2(np.maximum(level, 1)))
    else:
        rank = (level > 1) * (1 + (level > 16) + (level > 80))
    with np.errstate(over="ignore"):
        mixed = tokens * np.uint64(ORDERS[order])
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(MIX)
    return (rank.astype(np.uint64) << np.uint64(56)) | (mixed >> np.uint64(8))
