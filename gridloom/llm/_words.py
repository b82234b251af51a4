"""Words of many texts at a time, in numpy: where they are, 128-bit hashes, and a table from words to token ids.

Used inside Python workers. A hash of 128 bits stands for a word in the table; two words of one hash are not to
be expected in any corpus (under 2^-60 for 10^10 distinct words).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
SLICE_BYTES = 2 << 20


def text_slices(batch, column: int = 0, most: int = SLICE_BYTES) -> Iterator:
    """Parts of an Arrow batch of about ``most`` bytes of text each; a longer text is a part of its own."""
    sizes = _lengths(batch.column(column))
    at = 0
    while at < batch.num_rows:
        ends = np.searchsorted(np.cumsum(sizes[at:]), most, "right")
        yield batch.slice(at, max(1, int(ends)))
        at += max(1, int(ends))


def _lengths(column) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)


def joined(texts: list[bytes], before: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each after ``before``, with 8 more bytes at the end; and each text's start, with the end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(before)
    body = (before + before.join(texts) if texts else b"") if before else b"".join(texts)
    return np.frombuffer(body + bytes(8), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def tokens(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between separators (a table of 256 flags); with ``keep`` a run starts with its separators."""
    end = int(offsets[-1])
    gap = separator[buf[:end]]
    edge = np.zeros(end + 1, bool)
    edge[offsets] = True
    last = np.empty(end + 1, bool)
    last[0], last[1:] = True, gap
    if keep:
        starts = np.flatnonzero(gap & (~last[:-1] | edge[:-1]))
        return starts, np.append(starts[1:], end)
    starts = np.flatnonzero(~gap & (last[:-1] | edge[:-1]))
    following = np.append(gap[1:], True)
    return starts, np.flatnonzero(~gap & (following | edge[1:])) + 1


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each run of bytes, 8 bytes a step."""
    eight = np.ndarray((max(0, len(buf) - 7),), "<u8", buf, strides=(1,)) if len(buf) > 7 else np.zeros(1, "<u8")
    sizes = ends - starts
    a, b = sizes.astype(np.uint64) * K1, (sizes.astype(np.uint64) + K3) * K2
    left, at, who = sizes.copy(), starts.copy(), slice(None)
    with np.errstate(over="ignore"):
        while len(at):
            word = eight[at]
            short = left < 8
            word = np.where(short, word & ((np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1)), word)
            x, y = a[who] ^ word, b[who] + word
            x, y = x * K2, y * K3
            x ^= x >> np.uint64(29)
            y ^= y >> np.uint64(31)
            a[who], b[who] = x * K1, y * K2
            more = left > 8
            index = np.flatnonzero(more) if isinstance(who, slice) else who[more]
            left, at, who = left[more] - 8, at[more] + 8, index
        a ^= a >> np.uint64(32)
        b ^= b >> np.uint64(32)
    return a * K3, b * K1


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct (a, b) the place of one; and for each word the number of its distinct one."""
    _, first, inverse = np.unique(a, return_index=True, return_inverse=True)
    if not np.array_equal(b[first][inverse], b):  # words that share the first hash
        both = np.empty(len(a), [("a", "u8"), ("b", "u8")])
        both["a"], both["b"] = a, b
        _, first, inverse = np.unique(both, return_index=True, return_inverse=True)
    return first, inverse


def _flat(ids: list) -> np.ndarray:
    if isinstance(ids[0], array):
        return np.frombuffer(b"".join(x.tobytes() for x in ids), np.uint32)
    return np.fromiter(chain.from_iterable(ids), np.uint32)


class WordTable:
    """Token ids of words by hash, in flat arrays. Beyond ``most`` words or 8 times as many ids it starts anew, which costs time only."""

    def __init__(self, most: int = 1_000_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.a, self.b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.n, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each word in the table, or -1."""
        if not len(self.a):
            return np.full(len(a), -1)
        at = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1)
        return np.where((self.a[at] == a) & (self.b[at] == b), at, -1)

    def add(self, a: np.ndarray, b: np.ndarray, ids: list) -> None:
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, *([_flat(ids)] if len(ids) and n.sum() else [])])
        order = np.argsort(a, kind="stable")
        a, b, n, at = a[order], b[order], n[order], at[order]
        place = np.searchsorted(self.a, a)
        self.a, self.b, self.n, self.at = (np.insert(old, place, new) for old, new in ((self.a, a), (self.b, b), (self.n, n), (self.at, at)))

    def ids_of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and each word's number of ids. ``learn`` encodes a list of new distinct words."""
        a, b = hashes(buf, starts, ends)
        if not len(a):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        first, inverse = distinct(a, b)
        if len(self.a) + len(first) > self.most or len(self.flat) > 8 * self.most:
            self.clear()
        ka, kb = a[first], b[first]
        new = np.flatnonzero(self.find(ka, kb) < 0)
        if len(new):
            body, s, e = buf.tobytes(), starts[first[new]].tolist(), ends[first[new]].tolist()
            self.add(ka[new], kb[new], learn([body[i:j] for i, j in zip(s, e, strict=True)]))
        at = self.find(ka, kb)
        if (at < 0).any():  # words that share the first hash with another in the table: by a table of their own
            odd = np.flatnonzero(at < 0)
            body = buf.tobytes()
            start = len(self.flat)
            ids = learn([body[i:j] for i, j in zip(starts[first[odd]].tolist(), ends[first[odd]].tolist(), strict=True)])
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat = np.concatenate([self.flat, *(np.asarray(x, np.uint32) for x in ids)])
            count, begin = self.n[at], self.at[at]
            count[odd], begin[odd] = n, start + np.cumsum(n) - n
        else:
            count, begin = self.n[at], self.at[at]
        sizes, begins = count[inverse], begin[inverse]
        return self.flat[spread(begins, sizes)], sizes


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0]+1, ... (sizes[0] of them), begins[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def per_text(offsets: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``sizes`` over the words of each text, as running ends with a leading 0."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return total[np.searchsorted(starts, offsets)]
