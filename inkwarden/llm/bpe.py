"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the whole vocabulary resolves a pre-token that is itself a vocabulary
entry in one probe. Tier 2: other pre-tokens are merged with a heap of candidate pairs over a doubly
linked list of byte spans. The vocabulary is a file of fixed size, so its tables are broadcast.

Results: null texts count as empty; empty texts give zero tokens and the digest of nothing; repeated rows
give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
import weakref
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memo import Memo

_MASK = (1 << 64) - 1
#: Words that a worker remembers (at most twice as many, with those being forgotten), and marks that stay one pre-token after letters.
WORDS, MARKS = 150_000, frozenset(".,;:!?")
#: Bytes of the texts that are encoded together.
PART = 1_000_000
#: A space that no visible character follows, and the place before one that a visible character follows.
LOOSE, CUT = re.compile(r" (?:\s|\Z)"), re.compile(r"(?<!\s)(?= \S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file (``base64 rank`` lines) as bytes -> rank; the file belongs to the driver's installation."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _tables(path: str) -> tuple:
    ranks = read_ranks(path)
    return ranks, PerfectHash(ranks)


class PerfectHash:
    """Minimal perfect hash: ``n`` keys in ``n`` slots, by hash and displace.

    Keys are dealt to buckets; the buckets, largest first, each look for the displacement that sends all
    their keys to free slots; single keys take the slots left over directly (negative displacement).
    """

    def __init__(self, items: dict[bytes, int]):
        n = self.n = max(1, len(items))
        self.r = 2 * n // 3 + 1
        self.shift = [0] * self.r
        self.keys: list[bytes | None] = [None] * n
        self.ids = [0] * n
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(self.r)]
        for key in items:
            h = xxhash.xxh64_intdigest(key)
            buckets[h % self.r].append((h, key))
        for b in sorted((b for b in range(self.r) if len(buckets[b]) > 1), key=lambda b: -len(buckets[b])):
            group, d = buckets[b], 0
            while True:
                slots = [self._slot(h, d) for h, _ in group]
                if all(self.keys[s] is None for s in slots) and len(set(slots)) == len(slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, key) in zip(slots, group):
                self.keys[s], self.ids[s] = key, items[key]
        free = (i for i in range(n) if self.keys[i] is None)
        for b in range(self.r):
            if len(buckets[b]) == 1:
                slot, key = next(free), buckets[b][0][1]
                self.shift[b] = -slot - 1
                self.keys[slot], self.ids[slot] = key, items[key]

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15 & _MASK)) * 0xBF58476D1CE4E5B9) & _MASK
        return (x >> 29) % self.n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.r]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.ids[slot] if self.keys[slot] == key else None


def heap_merge(token: bytes, ranks: dict[bytes, int], first: list[int | None]) -> list[int]:
    """Ids of one pre-token: lowest rank first, leftmost on ties, over linked byte spans.

    ``first`` has the ranks of all pairs of bytes."""
    n, get = len(token), ranks.get
    shift = n.bit_length()
    end = list(range(1, n + 2))  # span i is token[i:end[i]]; the next span starts at end[i]
    before = list(range(-1, n))
    rank_at: list[int | None] = [first[a << 8 | b] for a, b in zip(token, token[1:])] + [None, None]  # of the pair that starts at i, None once it is gone
    heap = [r << shift | i for i, r in enumerate(rank_at) if r is not None]
    heapq.heapify(heap)
    mask, pop, push = (1 << shift) - 1, heapq.heappop, heapq.heappush
    while heap:
        x = pop(heap)
        i = x & mask
        if rank_at[i] != x >> shift:
            continue  # one side has merged meanwhile
        j = end[i]
        stop = end[i] = end[j]
        rank_at[j] = rank_at[i] = None
        if stop < n:
            before[stop] = i
            if (r := get(token[i : end[stop]])) is not None:
                rank_at[i] = r
                push(heap, r << shift | i)
        p = before[i]
        if p >= 0:
            rank_at[p] = r = get(token[p:stop])
            if r is not None:
                push(heap, r << shift | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = end[i]
    return out


class Words(Memo):
    """A word of letters -> the packed ids of a space and the word, remembered; other pieces are put together."""

    def __init__(self, codec: Codec):
        super().__init__(lambda word: codec._ids(b" " + word.encode()), WORDS)
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            return super().__missing__(piece)
        if piece[-1:] in MARKS and piece[:-1].isalpha():
            return self[piece[:-1]] + self.codec.tokens[piece[-1]]
        return self.codec._fresh(f" {piece}")


class Codec:
    """Encoder and decoder of one worker.

    A text is cut before every space that a visible character follows; there a pre-token always begins, so
    the cut changes no result. A piece of letters only, or letters and one mark, needs no pattern.
    """

    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash, pattern: str):
        self.ranks, self.whole, self.find = ranks, whole, regex.compile(pattern).findall
        self.first = [ranks.get(bytes((i >> 8, i & 255))) for i in range(1 << 16)]
        own = weakref.proxy(self)  # no cycle: a codec that goes leaves at once
        self.words = Words(own)
        self.tokens = Memo(lambda token: own._token(token), WORDS // 10)
        self.arrow: pa.Array | None = None
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token

    def _ids(self, token: bytes) -> bytes:
        rank = self.whole.get(token)
        ids = [rank] if rank is not None else heap_merge(token, self.ranks, self.first)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _token(self, token: str) -> bytes:
        return self.words[token[1:]] if token[0] == " " and token[1:].isalpha() else self._ids(token.encode())

    def _fresh(self, text: str) -> bytes:
        return b"".join([self.tokens[t] for t in self.find(text)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        get = self.words
        if LOOSE.search(text):  # several spaces in a row: cut at the others only
            first, *rest = CUT.split(text)
            return self._fresh(first) + b"".join([self._fresh(p) if LOOSE.search(p) else get[p[1:]] for p in rest])
        first, *rest = text.split(" ")
        return self._fresh(first) + b"".join([get[p] for p in rest])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """``encode`` of every text: each distinct piece is looked up once, the ids are put in place by Arrow."""
        texts = pc.fill_null(texts, "")
        loose = {i: t for i, t in enumerate(texts.to_pylist()) if LOOSE.search(t)}
        if loose:  # these are one piece each
            texts = pc.if_else(pa.array([i not in loose for i in range(len(texts))]), texts, "")
        split = pc.split_pattern(texts, " ")
        ends, pieces = split.offsets.to_numpy(), split.flatten()
        later = np.ones(len(pieces), bool)
        later[ends[:-1]] = False
        coded = pieces.filter(pa.array(later)).dictionary_encode()
        found = list(map(self.words.__getitem__, coded.dictionary.to_pylist()))
        at = np.empty(len(pieces), np.int64)
        at[later] = coded.indices.to_numpy()
        at[~later] = len(found) + np.arange(len(texts))
        found += [self.encode(loose[i]) if i in loose else self._fresh(t) for i, t in enumerate(pieces.filter(pa.array(~later)).to_pylist())]
        return _rows(pa.array(found, pa.large_binary()).take(pa.array(at)), ends)

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """``decode`` of all that ``encode_all`` gave."""
        ends = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1] // 4
        if self.arrow is None:
            self.arrow = pa.array(self.pieces, pa.large_binary())
        return _rows(self.arrow.take(pa.array(np.frombuffer(ids.buffers()[2] or b"", "<u4")[: ends[-1]])), ends)


def _rows(joined: pa.Array, ends: np.ndarray) -> pa.Array:
    """Byte strings as one for each row, which has those from one of ``ends`` to the next; a fresh array."""
    at = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1][ends]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at.astype(np.int32)), joined.buffers()[2] or pa.py_buffer(b"")])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` by rows whose texts (column 1) have about ``PART`` bytes together, at least one row each."""
    sizes, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, PART + (sizes[at - 1] if at else 0), side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _codec(shared, pattern: str) -> Codec:
    """One codec for each worker process and broadcast; it goes with the broadcast, so that later stages have its memory."""
    held = vars(shared).setdefault("codecs", {})
    if pattern not in held:
        held[pattern] = Codec(*shared.value, pattern)
    return held[pattern]


def encode(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, decode: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (``id_col`` if none are named), ``ids`` (binary, little-endian unsigned 32-bit) and, with
    ``decode``, ``decoded`` (binary): what decoding the ids gives.

    One narrow pass without a shuffle; each text is encoded whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_tables(ranks_path))
    kept = docs.select(*(keep or [id_col]))
    source = docs.select(F.struct(*kept.columns).alias("kept"), F.col(text_col).alias("text"))
    names = ["kept", "ids", "decoded"][: 2 + decode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            for part in _parts(batch):
                cols = [part.column(0), codec.encode_all(part.column(1))]
                if decode:
                    cols.append(codec.decode_all(cols[1]))
                yield pa.RecordBatch.from_arrays(cols, names=names)
        pa.default_memory_pool().release_unused()

    out = source.mapInArrow(run, f"kept {kept.schema.simpleString()}, ids binary" + ", decoded binary" * decode)
    return out.select(*(F.col("kept").getField(c).alias(c) for c in kept.columns), *names[1:])


def n_tokens(ids: str | Column = "ids") -> Column:
    """Number of ids in an ``ids`` column."""
    return F.expr(f"octet_length({ids}) div 4").cast("long") if isinstance(ids, str) else (F.octet_length(ids) / 4).cast("long")
