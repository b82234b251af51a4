"""Token-ID files: independent zstandard frames with a trailing seek table and per-frame checksums.

A file is a row of zstandard frames, then two skippable frames: an index (which documents and tokens each frame
holds) and the seek table of the public zstandard seekable format (sizes and the low 32 bits of XXH64 of each
frame's content). Readers fetch the end of the file, then only the frames of the documents they want. Any
zstandard tool decompresses the whole file too.

A frame's content, little-endian: b"TOKF", uint32 documents, int64 doc_id each, uint8 null flag each, uint32
tokens each, uint32 ids of all. Frames end at FRAME_TOKENS; a longer document has a frame of its own.

Documents are range-partitioned and sorted by doc_id, so files by name and frames by place are in ascending
doc_id order. Defined results: null text counts as empty and holds the end id only; a null doc_id sorts first;
rows that repeat a doc_id stand side by side, by text; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._common import fresh_path, shuffle_partitions, table
from gridloom.llm._files import new_file, open_file

END_ID = 1
FRAME_TOKENS = 1 << 16
MAGIC, SEEK_MAGIC = b"TOKF", 0x8F92EAB1  # the second is fixed by the seekable format
SKIP_INDEX, SKIP_SEEK = 0x184D2A50, 0x184D2A5E  # skippable frames; the second is fixed by the seekable format
NO_ID = -(1 << 63)
#: The rule by which the tokenizer cuts words: a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts as bytes of little-endian uint32, by the tokenizers library.

    The tokenizer drops white space, no rule of it looks across a space or line feed and no special token holds
    one, so a text's ids are those of its words in order. Where the file's rules are the known ones (see SPLIT),
    words are cut further where these rules always cut, and ASCII capitals are lowered first, as the rules do; so a
    word has one entry whatever stands before or after it. Each distinct unit is encoded once and remembered.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from gridloom.llm._words import WordTable

        with open(path, encoding="utf-8") as f:
            self.fine = cuts_are_known(json.load(f))
        self.tokenizer, self.known = Tokenizer.from_file(path), WordTable()
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)

    def _learn(self, words: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self._batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        from gridloom.llm._words import joined, per_text, tokens

        buf, offsets = joined(texts)
        starts, ends = tokens(buf, offsets, _gaps())
        if self.fine:
            buf, starts, ends = units(buf, offsets, starts, ends)
        ids, sizes = self.known.ids_of(buf, starts, ends, self._learn)
        body, cuts = ids.astype("<u4").tobytes(), (4 * per_text(offsets, starts, sizes)).tolist()
        return [body[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


@lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(1)
def _gaps():
    import numpy as np

    gaps = np.zeros(256, bool)
    gaps[[0x20, 0x0A]] = True
    return gaps


def cuts_are_known(rules: dict) -> bool:
    """Whether a tokenizer's file has the rules that ``units`` goes by."""
    try:
        first, second = rules["pre_tokenizer"]["pretokenizers"]
        return (
            first["type"] == "Split" and first["pattern"]["Regex"] == SPLIT and first["behavior"] == "Removed" and first["invert"] is True
            and second["type"] == "ByteLevel" and not second["add_prefix_space"] and not second["use_regex"]
            and [x["type"] for x in rules["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
            and all(x["content"].startswith("<|") and x["content"].endswith("|>") and " " not in x["content"] for x in rules["added_tokens"])
        )
    except (KeyError, TypeError, ValueError, IndexError):
        return False


@lru_cache(1)
def _tables():
    """Kind of each byte (0 other, 1 ASCII letter, 2 digit, 3 other visible ASCII, 4 apostrophe), which kinds are cut apart, and lower case."""
    import numpy as np

    kind = np.zeros(256, np.uint8)
    kind[0x21:0x7F] = 3
    kind[ord("0") : ord("9") + 1] = 2
    kind[ord("A") : ord("Z") + 1] = kind[ord("a") : ord("z") + 1] = 1
    kind[ord("'")] = 4
    cut = np.zeros((5, 5), bool)
    # A letter run ends at what is no letter, a digit stands alone, a run of other characters ends at a letter or
    # digit; but an apostrophe may belong to the letters after it. Nothing is cut next to a byte that is not ASCII.
    cut[1, 2:] = cut[2, 1:] = cut[3, 1:3] = True
    cut[4, 2] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    return kind, cut.ravel(), lower


def units(buf, offsets, starts, ends):
    """``buf`` in lower case and the starts and ends of the words' units. Words with "<|", which may hold a special token, stay as they are."""
    import numpy as np

    kind, cut, lower = _tables()
    body = buf[: int(offsets[-1])]
    kinds = kind[body]
    inside = np.zeros(len(body), bool)
    inside[1:] = cut[kinds[:-1] * np.uint8(5) + kinds[1:]]
    inside[offsets[:-1][offsets[:-1] < len(body)]] = False  # a text's start is a word's start or a gap
    lowered = lower[buf]
    odd = np.flatnonzero((body[:-1] == ord("<")) & (body[1:] == ord("|"))) if len(body) else []
    for k in np.unique(np.searchsorted(starts, odd, "right") - 1) if len(odd) else ():
        inside[starts[k] : ends[k]] = False
        lowered[starts[k] : ends[k]] = buf[starts[k] : ends[k]]
    more = np.flatnonzero(inside)
    return lowered, np.sort(np.concatenate([starts, more])), np.sort(np.concatenate([ends, more]))


class FrameWriter:
    """Writes one file; documents must come in order."""

    def __init__(self, out, frame_tokens: int = FRAME_TOKENS, level: int = 3):
        import xxhash
        import zstandard

        self.out, self.frame_tokens, self.sum = out, frame_tokens, xxhash.xxh64_intdigest
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.frames: list[tuple] = []  # packed size, content size, checksum, documents, tokens, first and last doc_id
        self.ids: list[int | None] = []
        self.parts: list[bytes] = []
        self.waiting = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.parts and self.waiting + len(ids) // 4 > self.frame_tokens:
            self._frame()
        self.ids.append(doc_id)
        self.parts.append(ids)
        self.waiting += len(ids) // 4

    def _frame(self) -> None:
        n, keys = len(self.ids), [NO_ID if x is None else x for x in self.ids]
        head = MAGIC + struct.pack(f"<I{n}q{n}B{n}I", n, *(0 if x is None else x for x in self.ids), *(x is None for x in self.ids), *(len(x) // 4 for x in self.parts))
        content = head + b"".join(self.parts)
        packed = self.packer.compress(content)
        self.out.write(packed)
        self.frames.append((len(packed), len(content), self.sum(content) & 0xFFFFFFFF, n, self.waiting, keys[0], keys[-1]))
        self.ids, self.parts, self.waiting = [], [], 0

    def close(self) -> None:
        if self.parts:
            self._frame()
        index = b"".join(struct.pack("<IQqq", *f[3:]) for f in self.frames)
        self.out.write(struct.pack("<II", SKIP_INDEX, len(index)) + index)
        seek = b"".join(struct.pack("<III", *f[:3]) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIP_SEEK, len(seek)) + seek)


class FrameReader:
    """Reads the end of a file, then only the frames that are asked for."""

    def __init__(self, source):
        import zstandard

        self.source, size = source, source.size()
        frames, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table")
        seek = self._read(size - 9 - 12 * frames, 12 * frames)
        index = self._read(size - 17 - 12 * frames - 28 * frames, 28 * frames)
        self.unpacker, self.frames, at = zstandard.ZstdDecompressor(), [], 0
        for packed, rest in zip(struct.iter_unpack("<III", seek), struct.iter_unpack("<IQqq", index), strict=True):
            self.frames.append((at, *packed, *rest))
            at += packed[0]
        self.decompressed = 0

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, k: int) -> Iterator[tuple[int | None, memoryview]]:
        import xxhash

        at, packed, size, checksum = self.frames[k][:4]
        content = self.unpacker.decompress(self._read(at, packed), max_output_size=size)
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum or content[:4] != MAGIC:
            raise ValueError(f"frame {k} is damaged")
        self.decompressed += 1
        (n,) = struct.unpack_from("<I", content, 4)
        values = struct.unpack_from(f"<{n}q{n}B{n}I", content, 8)
        view, at = memoryview(content), 8 + 13 * n
        for doc_id, null, tokens in zip(values[:n], values[n : 2 * n], values[2 * n :], strict=True):
            yield (None if null else doc_id), view[at : at + 4 * tokens]
            at += 4 * tokens

    def __iter__(self):
        for k in range(len(self.frames)):
            yield from self.frame(k)

    def documents(self, wanted: set[int]) -> dict[int, bytes]:
        """Ids of the wanted documents; frames that hold none of them stay compressed."""
        out: dict[int, bytes] = {}
        for k, f in enumerate(self.frames):
            if any(f[6] <= x <= f[7] for x in wanted):
                out |= {doc_id: bytes(ids) for doc_id, ids in self.frame(k) if doc_id in wanted}
        return out


def write_token_files(docs: DataFrame, uri: str, vocab: str | None = None, end_id: int = END_ID, frame_tokens: int = FRAME_TOKENS) -> DataFrame:
    """Encode, write files under ``uri`` and return their list: part, uri, n_docs, n_tokens."""
    vocab = vocab or vocabulary()
    in_order = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from gridloom.llm._words import text_slices

        part, end = TaskContext.get().partitionId(), struct.pack("<I", end_id)
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        encoder, docs_n, tokens = _encoder(vocab), 0, 0
        with new_file(target := f"{uri}/part-{part:06d}.tokens.zst") as out:
            writer = FrameWriter(out, frame_tokens)
            while first is not None:
                for piece in text_slices(first, 1):
                    for doc_id, ids in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).cast("binary").to_pylist()), strict=True):
                        writer.add(doc_id, ids + end)
                        docs_n, tokens = docs_n + 1, tokens + len(ids) // 4 + 1
                first = next(batches, None)
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [target], "n_docs": pa.array([docs_n], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    spark = docs.sparkSession
    listing = in_order.mapInArrow(write, "part int, uri string, n_docs long, n_tokens long")
    listing.write.parquet(f"{uri}/_files")
    return spark.read.schema(listing.schema).parquet(f"{uri}/_files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of each document, read from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("uri", "start")
    return placed.repartition(shuffle_partitions(files.sparkSession)).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def _read(batches, with_ids: bool = True):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with open_file(uri) as source:
                reader = FrameReader(source)
                for k in range(len(reader.frames)):
                    rows = list(reader.frame(k))
                    sizes = [len(x) // 4 for _, x in rows]
                    starts = start + np.cumsum([0, *sizes])
                    columns = {
                        "doc_id": pa.array([x for x, _ in rows], pa.int64()), "start": pa.array(starts[:-1], pa.int64()), "n_tokens": pa.array(sizes, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x) for _, x in rows], pa.int64()),
                    }
                    if with_ids:
                        flat = np.frombuffer(b"".join(x for _, x in rows), "<u4").astype(np.int64)
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat))
                    start = int(starts[-1])
                    yield pa.RecordBatch.from_pydict(columns)


def read_token_digests(files: DataFrame) -> DataFrame:
    """As ``read_token_files`` without the ids themselves."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("uri", "start")
    return placed.repartition(shuffle_partitions(files.sparkSession)).mapInArrow(lambda b: _read(b, False), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_digests(write_token_files(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens")))
