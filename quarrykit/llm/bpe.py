"""Problem 6: encode whole columns of text with a public byte-level BPE.

Two tiers per batch of text, both over arrays rather than rows:

1. The text is cut into pre-tokens by character classes, each pre-token is
   hashed from one prefix sum, and a minimal perfect hash over the vocabulary
   answers those that are vocabulary entries themselves.
2. The distinct rest is merged byte by byte with a heap of candidate merges
   over a doubly linked list.
"""
from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import SpanHash, mix

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

LETTER, NUMBER, BLANK = 1, 2, 3
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters that are worked on at a time; a longer text is taken alone, and whole.
CHUNK_CHARS = 1 << 19
#: Merged pre-tokens that one task remembers; beyond it the memory starts anew.
MEMORY = 1 << 18


def read_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    """Token bytes to id, from a rank file (base64 token and rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, blank, or 0 for the others."""
    table = np.zeros(0x110000, np.uint8)
    first = {"L": LETTER, "N": NUMBER}
    for point in range(sys.maxunicode + 1):
        kind = first.get(unicodedata.category(chr(point))[0])
        if kind:
            table[point] = kind
    table[WHITE_SPACE] = BLANK
    return table


class PerfectHash:
    """Minimal perfect hash of 64-bit keys: levels of bit arrays with ranks.

    A key takes the first level on which its bit was not contested while the
    table was built; the number of bits set before it is its place. A stored
    copy of the key tells strangers from members, up to strangers with an equal
    key, which the caller tells by their bytes.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order, self.levels, left, before = [], [], np.arange(len(keys)), 0
        while len(left):
            size = np.uint64(2 * len(left) + 1)
            place = (mix(keys[left] + np.uint64(len(self.levels))) % size).astype(np.int64)
            count = np.bincount(place, minlength=int(size))
            alone = count[place] == 1
            bits = np.zeros(int(size), bool)
            bits[place[alone]] = True
            self.levels.append((size, bits, before + np.cumsum(bits) - bits))
            taken = left[alone]
            order.append(taken[np.argsort(place[alone])])
            before += len(taken)
            left = left[~alone]
        at = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.keys, self.values = keys[at], values[at]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for keys that are no members."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, bits, rank) in enumerate(self.levels):
            if not len(left):
                break
            own = keys[left]
            place = (mix(own + np.uint64(level)) % size).astype(np.int64)
            hit = bits[place]
            at = rank[place[hit]]
            same = self.keys[at] == own[hit]
            found[left[hit][same]] = self.values[at[same]]
            left = left[~hit]
        return found


class Spans:
    """Byte spans of one buffer, compared eight bytes at a time."""

    def __init__(self, data: bytes):
        self.data = data + bytes(8)
        self.words = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,))

    def same(self, start: np.ndarray, size: np.ndarray, other: Spans, other_start: np.ndarray, other_size: np.ndarray) -> np.ndarray:
        """Whether each span has the bytes of the one beside it in ``other``."""
        equal = size == other_size
        left = np.flatnonzero(equal)
        done = 0
        while len(left):
            rest = np.minimum(size[left] - done, 8)
            unused = (8 * (8 - rest)).astype(np.uint64)
            differ = (self.words[start[left] + done] ^ other.words[other_start[left] + done]) << unused
            equal[left[differ != 0]] = False
            done += 8
            left = left[(differ == 0) & (size[left] > done)]
        return equal


def byte_pairs(ranks: dict[bytes, int]) -> list[int]:
    """Rank of every pair of bytes by ``first * 256 + second``, -1 where there is none."""
    return [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Ids of one pre-token: always the leftmost pair of lowest rank is merged next.

    The pieces form a doubly linked list over byte offsets; ``own[i]`` is the
    rank of the piece at i joined with the next one. A heap holds the candidate
    merges as rank and place in one number; those whose rank is no longer that
    of their place are skipped.
    """
    n, rank_of = len(piece), ranks.get
    own = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
    own.append(-1)
    shift = n.bit_length()
    mask = (1 << shift) - 1
    heap = [rank << shift | i for i, rank in enumerate(own) if rank >= 0]
    heapq.heapify(heap)
    before, after = list(range(-1, n)), list(range(1, n + 1))
    while heap:
        best = heapq.heappop(heap)
        i = best & mask
        if own[i] != best >> shift:
            continue
        gone = after[i]
        own[gone] = -2
        after[i] = j = after[gone]
        before[j] = i
        own[i] = -1
        if j < n:
            rank = rank_of(piece[i : after[j]])
            if rank is not None:
                own[i] = rank
                heapq.heappush(heap, rank << shift | i)
        h = before[i]
        if h >= 0:
            rank = rank_of(piece[h:j])
            if rank is None:
                own[h] = -1
            else:
                own[h] = rank
                heapq.heappush(heap, rank << shift | h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def cut(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points of several texts.

    ``first`` marks each text's first character. The cut is that of the
    vocabulary's split pattern: contractions; letters, numbers or other
    characters, each with at most one leading space; runs of blanks, of which
    the last one is left to what follows.
    """
    kind = classes[points]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    after_blank = np.flatnonzero((kind[1:] != BLANK) & (kind[:-1] == BLANK) & ~first[1:]) + 1
    start[after_blank - 1] = True
    start[after_blank] = points[after_blank - 1] != 0x20
    mark = np.flatnonzero((points == 0x27) & start)
    mark = mark[mark + 1 < len(points)]
    mark = mark[(kind[mark + 1] == LETTER) & ~first[mark + 1]]
    if len(mark):
        one = points[mark + 1]
        two = np.full(len(mark), 0, points.dtype)
        inside = mark + 2 < len(points)
        two[inside] = np.where(first[mark[inside] + 2], 0, points[mark[inside] + 2])
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for pair in ("re", "ve", "ll"):
            size = np.where((one == ord(pair[0])) & (two == ord(pair[1])), 3, size)
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        start[np.where(size == 3, mark + 2, mark)[size == 3]] = False
        stop = mark + size
        start[stop[stop < len(points)]] = True
    return start


def vocabulary(path: str = DEFAULT_RANKS) -> dict:
    """What an ``Encoder`` is made of, as plain arrays, lists and dicts.

    Built once on the driver and broadcast; a broadcast is pickled plainly, so
    it must not hold objects of this package, which executors have no copy of.
    Its size is that of the vocabulary and of the class table, whatever the data.
    """
    ranks = read_ranks(path)
    whole = b"".join(ranks)
    size = np.array([len(t) for t in ranks], np.int64)
    start = np.cumsum(size) - size
    order = np.arange(len(ranks))
    table = PerfectHash(SpanHash()(np.frombuffer(whole, np.uint8), start, start + size), order)
    return {
        "ranks": ranks, "ids": np.array(list(ranks.values()), np.int64), "whole": whole, "start": start, "size": size,
        "levels": table.levels, "keys": table.keys, "order": table.values, "pairs": byte_pairs(ranks), "classes": character_classes(),
    }


class Encoder:
    """Encodes batches of texts; each worker builds its own from the broadcast ``vocabulary``."""

    def __init__(self, made: dict | None = None):
        made = made or vocabulary()
        self.ranks, self.pairs, self.classes, self.ids = made["ranks"], made["pairs"], made["classes"], made["ids"]
        self.tokens, self.token_start, self.token_size = Spans(made["whole"]), made["start"], made["size"]
        self.longest = int(self.token_size.max(initial=0))
        self.table = PerfectHash.__new__(PerfectHash)
        self.table.levels, self.table.keys, self.table.values = made["levels"], made["keys"], made["order"]
        self.hash, self.memory = SpanHash(1 << 12), {}

    def _merged(self, piece: bytes) -> list[int]:
        known = self.memory.get(piece)
        if known is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[piece] = known = merge(piece, self.ranks, self.pairs)
        return known

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        whole = b"".join(texts)
        data = np.frombuffer(whole, np.uint8)
        text_start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        if whole.isascii():
            points, at = data, None
        else:
            points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
            at = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.zeros(len(data), bool)
        first[text_start[sizes > 0]] = True
        if at is not None:
            first = first[at]
        start = np.flatnonzero(cut(points, first, self.classes))
        if at is not None:
            start = at[start]
        stop = np.append(start[1:], len(data))
        size = stop - start
        keys = self.hash(data, start, stop)
        found = self.table.find(keys)
        found[size > self.longest] = -1
        # a hit is one of key; its bytes decide
        hit = np.flatnonzero(found >= 0)
        spans, token = Spans(whole), found[hit]
        stranger = ~spans.same(start[hit], size[hit], self.tokens, self.token_start[token], self.token_size[token])
        found[hit] = self.ids[token]
        found[hit[stranger]] = -1
        miss = np.flatnonzero(found < 0)
        width = np.ones(len(start), np.int64)
        if len(miss):
            _, where, which = np.unique(keys[miss], return_index=True, return_inverse=True)
            like = miss[where][which]
            alone = np.flatnonzero(~spans.same(start[miss], size[miss], spans, start[like], size[like]))
            which[alone] = len(where) + np.arange(len(alone))
            merged = [self._merged(whole[start[i] : stop[i]]) for i in np.concatenate([miss[where], miss[alone]])]
            counts = np.array([len(x) for x in merged], np.int64)
            flat = np.fromiter((y for x in merged for y in x), np.int64, int(counts.sum()))
            base = np.cumsum(counts) - counts
            width[miss] = counts[which]
        place = np.cumsum(width) - width
        ids = np.empty(int(width.sum()), np.int32)
        hit = found >= 0
        ids[place[hit]] = found[hit]
        if len(miss):
            n = counts[which]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ids[np.repeat(place[miss], n) + step] = flat[np.repeat(base[which], n) + step]
        owner = np.searchsorted(text_start[sizes > 0], start, side="right") - 1
        count = np.zeros(len(texts), np.int64)
        count[np.flatnonzero(sizes > 0)] = np.bincount(owner, weights=width, minlength=int((sizes > 0).sum())).astype(np.int64)
        return ids, count


def _valid(text: bytes) -> bytes:
    """Malformed UTF-8 is taken as it is decoded, with U+FFFD for what has no meaning."""
    try:
        text.decode("utf-8")
        return text
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode("utf-8")


def chunks(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a column as UTF-8, nulls as empty, in pieces of about CHUNK_CHARS."""
    part, size = [], 0
    for text in column.cast(pa.large_binary()).to_pylist():
        part.append(text if text is not None and text.isascii() else _valid(text or b""))
        size += len(part[-1])
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _vocabulary(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(vocabulary(path))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``key`` and ``ids``, the token ids of ``text`` without special tokens.

    Empty and null texts give an empty list, blank ones their blanks' ids.
    Text of special tokens is ordinary text. Every row gives one row, repeated
    keys too; other columns are not read. An empty table gives an empty table.
    The broadcast holds the vocabulary, whose size does not depend on the data.
    """
    shared = _vocabulary(df, ranks)
    source = df.select(F.col(key), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            done = 0
            for part in chunks(batch.column(1)):
                ids, count = encoder(part)
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), lists], names=[key, "ids"])
                done += len(part)

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``key`` and ``n_tokens``; null and empty texts have none."""
    shared = _vocabulary(df, ranks)
    source = df.select(F.col(key), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            counts = [encoder(part)[1] for part in chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=[key, "n_tokens"])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
