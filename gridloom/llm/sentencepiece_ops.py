"""SentencePiece encoding and decoding by a shared-prefix Viterbi search over distinct marked words.

A text is cut into marked words (a run of the marker, then what is not the marker); no piece of the model crosses
such a cut. The distinct words of a batch are sorted, which is the depth-first order of their trie: going from one
word to the next, the forward states of the common prefix stay and only the rest is computed. A forward state at
place i holds the best path that ends at i.

Two kinds of model files are read. In a unigram model a path's score is the sum of its pieces' scores. In a BPE
model a step from piece s to piece t is allowed if merging the text of s + t gives back s, t, and forbidden
(score minus infinity) otherwise; by a known property of BPE exactly one path is allowed at each place, and it is
the encoding, so the same search gives the library's ids. Words that start with several markers are merged
directly, because the pieces of bare markers share one score. Words beyond LONG characters, which share no prefix
worth keeping, are searched with states for the longest piece only and a few bytes a character.

Defined results: null text counts as empty and has no ids; characters without a piece become byte pieces (or
unk if the model has none); a literal marker character decodes as a space, as in the library. Further columns
are kept; rows are independent, so repeated rows give repeated results and an empty table an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm._common import table

MARK = "▁"
#: Pairs of pieces of which a worker remembers whether they stay apart; beyond that it starts anew.
MEMO_PAIRS = 250_000
#: Characters from which a word is searched by itself, in flat arrays.
LONG = 1024
#: Stands for the last piece where there is none yet.
START = (1 << 24) - 1
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0  # of the library: a fixed value


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        rule = proto.normalizer_spec
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces:
            raise ValueError("only models with the identity normalisation are supported")
        self.kind, self.dummy = proto.trainer_spec.model_type, rule.add_dummy_prefix
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        usable = [(i, p) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)]
        self.ids = {p.piece: i for i, p in usable}
        self.scores = {p.piece: p.score for _, p in usable}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses words")
        self.longest = max(map(len, self.ids))
        self.least = min(self.scores.values()) - UNKNOWN_PENALTY
        #: Pieces that merging can give.
        self.whole = {p for p in self.ids if len(p) == 1 or self.kind == UNIGRAM or self.merge(p) == [p]}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.kept_pairs: dict[int, bool] = {}
        self.odd: dict[str, int] = {}  # characters without a piece get numbers after the pieces
        # Trie of the pieces: a node is its children by character, its piece's number (or -1) and its depth.
        self.root: tuple[dict, int, int] = ({}, -1, 0)
        for piece in self.whole:
            self._plant(piece, self.ids[piece])
        # The forward states of the last word. At each place: the best path's score, the number and length of its
        # last piece, and the pieces under way, longest first.
        self.word, self.best, self.last, self.sizes_, self.active = "", [0.0], [START], [0], [[]]
        self.raw, self.flat = [self._raw(i) for i in range(len(self.pieces))], None
        from gridloom.llm._words import WordTable

        self.known = WordTable()

    # -- encoding ------------------------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """BPE: merge the neighbours that form the best piece, the leftmost first, until none is left."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.scores.get(pair := parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-s, i, pair))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if parts[i] is None or j < 0 or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j], after[i] = pair, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def _number(self, symbol: str) -> int:
        found = self.ids.get(symbol)
        return found if found is not None else self.odd.setdefault(symbol, len(self.pieces) + len(self.odd))

    def _follows(self, s: str, t: str) -> bool:
        return s + t not in self.scores and self.merge(s + t) == [s, t]

    def _plant(self, piece: str, number: int) -> None:
        node = self.root
        for c in piece[:-1]:
            node = node[0].setdefault(c, ({}, -1, node[2] + 1))
        old = node[0].get(piece[-1], ({}, -1, 0))
        node[0][piece[-1]] = (old[0], number, node[2] + 1)

    def path(self, word: str) -> list[str]:
        """Viterbi; the forward states of the prefix that ``word`` shares with the last word stay."""
        best, last, sizes, active, old, same = self.best, self.last, self.sizes_, self.active, self.word, 0
        most = min(len(word), len(old))
        while same < most and word[same] == old[same]:
            same += 1
        del best[same + 1 :], last[same + 1 :], sizes[same + 1 :], active[same + 1 :]
        root, kept, unigram = self.root, self.kept_pairs, self.kind == UNIGRAM
        tops = root[0]
        for end in range(same + 1, len(word) + 1):
            c = word[end - 1]
            own = tops.get(c)
            if own is None or own[1] < 0:  # a character without a piece of its own becomes a symbol
                self._plant(c, self._number(c))
                own = tops[c]
            under_way = [child for node in active[end - 1] if (child := node[0].get(c))]
            under_way.append(own)
            top, piece, size = float("-inf"), -1, 0
            for _, number, depth in under_way:
                if number < 0:
                    continue
                start = end - depth
                if unigram:
                    if (score := best[start] + self.score(number)) > top:
                        top, piece, size = score, number, depth
                    continue
                pair = last[start] << 24 | number
                allowed = kept.get(pair)
                if allowed is None:
                    if len(kept) > MEMO_PAIRS:
                        kept.clear()
                    allowed = kept[pair] = not start or self._follows(word[start - sizes[start] : start], word[start:end])
                if allowed:  # the only path
                    top, piece, size = 0.0, number, depth
                    break
            best.append(top)
            last.append(piece)
            sizes.append(size)
            active.append(under_way)
        self.word = word
        out, end = [], len(word)
        while end:
            out.append(word[end - sizes[end] : end])
            end -= sizes[end]
        return out[::-1]

    def long_path(self, word: str):
        """As ``path`` for a word of any length: yields its pieces. A step looks back by the longest piece at most, so
        the pieces under way and the last pieces are kept for that many places, and of the rest only the sizes."""
        kept, unigram, window = self.kept_pairs, self.kind == UNIGRAM, self.longest + 1
        best, last, sizes = [0.0] * window, [START] * window, array("H", [0])
        under_way: list[tuple] = []
        for end in range(1, len(word) + 1):
            c = word[end - 1]
            own = self.root[0].get(c)
            if own is None or own[1] < 0:
                self._plant(c, self._number(c))
                own = self.root[0][c]
            under_way = [child for node in under_way if (child := node[0].get(c))]
            under_way.append(own)
            top, piece, size = float("-inf"), -1, 0
            for _, number, depth in under_way:
                if number < 0:
                    continue
                start = end - depth
                if unigram:
                    if (score := best[start % window] + self.score(number)) > top:
                        top, piece, size = score, number, depth
                    continue
                pair = last[start % window] << 24 | number
                allowed = kept.get(pair)
                if allowed is None:
                    if len(kept) > MEMO_PAIRS:
                        kept.clear()
                    allowed = kept[pair] = not start or self._follows(word[start - sizes[start] : start], word[start:end])
                if allowed:
                    top, piece, size = 0.0, number, depth
                    break
            best[end % window], last[end % window] = top, piece
            sizes.append(size)
        cuts, end = array("q"), len(word)
        while end:
            cuts.append(end)
            end -= sizes[end]
        for end in reversed(cuts):
            yield word[end - sizes[end] : end]

    def score(self, number: int) -> float:
        return self.scores[self.pieces[number]] if number < len(self.pieces) else self.least

    def word_ids(self, word: str):
        out = array("I")
        merged = self.kind == BPE and word.startswith(MARK * 2)
        for piece in self.merge(word) if merged else self.long_path(word) if len(word) > LONG else self.path(word):
            if (found := self.ids.get(piece)) is not None:
                out.append(found)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in piece.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def learn(self, words: list[bytes]) -> list:
        """Encode distinct words (their markers as spaces) in the order of their trie."""
        marked = [w.decode("utf-8", "replace").replace(" ", MARK) for w in words]
        out: list = [None] * len(marked)
        for i in sorted(range(len(marked)), key=marked.__getitem__):
            out[i] = self.word_ids(marked[i])
        return out

    def encode(self, texts: list[bytes]):
        """Ids of the texts one after another, and their running ends with a leading 0."""
        import numpy as np

        from gridloom.llm._words import joined, per_text, tokens

        space, mark = np.zeros(256, bool), MARK.encode()
        space[0x20] = True
        texts = [t.replace(mark, b" ") if mark in t else t for t in texts]
        # With the marker before each text every word begins with markers; an empty text has no words.
        buf, offsets = joined([b" " + t if t and self.dummy else t for t in texts])
        if not self.dummy and len(buf) > 8:
            return self._encode_plain(texts)
        starts, ends = tokens(buf, offsets, space, keep=True)
        ids, sizes = self.known.ids_of(buf, starts, ends, self.learn)
        return ids, per_text(offsets, starts, sizes)

    def _encode_plain(self, texts: list[bytes]):
        """For models without a leading marker, where a text's first word may have none."""
        import numpy as np

        found = array("I")
        ends = [0]
        for t in texts:
            for word in MARKED.findall(t.decode("utf-8", "replace").replace(" ", MARK)):
                found.extend(self.word_ids(word))
            ends.append(len(found))
        return np.array(found, np.uint32), np.array(ends)

    # -- decoding ------------------------------------------------------------------------------------------

    def _raw(self, i: int) -> bytes:
        kind, piece = self.types[i], self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def decode(self, ids, ends) -> list[str]:
        """Texts from flat ids and running ends with a leading 0."""
        import numpy as np

        from gridloom.llm._words import spread

        if self.flat is None:
            self.sizes = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
            self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        sizes = self.sizes[ids]
        begins = (np.cumsum(self.sizes) - self.sizes)[ids]
        body, cuts = self.flat[spread(begins, sizes)].tobytes(), np.concatenate([[0], np.cumsum(sizes)])[ends].tolist()
        texts = [body[i:j].decode("utf-8", "replace") for i, j in zip(cuts, cuts[1:], strict=False)]
        return [t[1:] if self.dummy and t.startswith(" ") else t for t in texts]


MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@lru_cache(2)
def _model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


def encode(df: DataFrame, model: str | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the column ``ids`` (array of int), in place of an older column of that name; with ``decoded`` also the text
    decoded from these ids, by the same Python worker. No shuffle; the model file is a path on the executors."""
    path = model or vocabulary()
    more = [ids, *([decoded] if decoded else [])]
    df = df.drop(*(x for x in more if x != text))
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    at = df.columns.index(text)

    def run(batches):
        import pyarrow as pa

        from gridloom.llm._words import text_slices

        pieces = _model(path)
        for whole in batches:
            for batch in text_slices(whole, at):
                flat, ends = pieces.encode(batch.column(at).cast("binary").fill_null(b"").to_pylist())
                added = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view("int32")))]
                if decoded:
                    added.append(pa.array(pieces.decode(flat, ends), pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *more])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the column ``text`` decoded from ``ids`` (null ids: empty), in place of an older column of that name."""
    path = model or vocabulary()
    df = df.drop(text) if ids != text else df
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])
    at = df.columns.index(ids)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute

        pieces = _model(path)
        for whole in batches:
            for batch in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
                lists = batch.column(at)
                sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
                texts = pieces.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(run, schema)


def encoded_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian int32), n_decoded (characters) and whether decoding gives the text back.

    One Python worker for each task encodes and decodes, so neither ids nor decoded texts go back to the JVM.
    """
    path = model or vocabulary()

    def digest(batches):
        import numpy as np
        import pyarrow as pa

        from gridloom.llm._words import text_slices

        pieces, mark = _model(path), MARK.encode()
        for whole in batches:
            for batch in text_slices(whole, 1):
                texts = batch.column(1).cast("binary").to_pylist()
                flat, ends = pieces.encode(texts)
                decoded = pieces.decode(flat, ends)
                little = flat.astype("<i4")
                sums = [zlib.crc32(little[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                same = [d.encode() == t.replace(mark, b" ") for d, t in zip(decoded, texts, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column(0), "n_ids": pa.array(np.diff(ends), pa.int64()), "ids_crc32": pa.array(sums, pa.int64()), "n_decoded": pa.array(map(len, decoded), pa.int64()), "round_trip": pa.array(same, pa.bool_())}
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(digest, "doc_id long, n_ids long, ids_crc32 long, n_decoded long, round_trip boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded for each document."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded").select("doc_id", "ids", "decoded")
