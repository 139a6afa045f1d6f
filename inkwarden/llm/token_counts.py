"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a block of text that a worker has not met yet are laid end to end in one array of symbol
ids. Each round looks up the rank of every neighbouring pair at once, finds the lowest rank of every
pre-token, and applies that pair wherever it stands in it. Rounds end when no pair is left; what counts is
how many symbols survive.

Results: null texts count as empty; empty texts have zero tokens; repeated rows give repeated results; the
vocabulary's added token, where its string stands in a text, is one token.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memo import Memo

#: Pre-tokens remembered (twice, with those being forgotten), pre-tokens merged together, the hash tables' size, and marks that stay one pre-token after letters.
TOKENS, BLOCK, _BITS, MARKS = 500_000, 50_000, 18, frozenset(".,;:!?")
_SLOTS = 1 << _BITS
#: A space that no visible character follows, and the place before one that a visible character follows.
LOOSE, CUT = re.compile(r" (?:\s|\Z)"), re.compile(r"(?<!\s)(?= \S)")
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others follow from U+0100 on in byte order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class RankMerger:
    def __init__(self, vocabulary: dict[str, int], merges: list, pattern: str, added: list[str]):
        self.size = len(vocabulary) + 1
        self.byte_id = np.zeros(256, np.int64)
        for symbol, byte in byte_symbols().items():
            self.byte_id[byte] = vocabulary[symbol]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.tables = []  # open hash tables of pair keys; what collides in one goes to the next
        left = np.arange(len(key))
        while len(left):
            slots = np.full(_SLOTS, -1, np.int64)
            at = self._slot(key[left], len(self.tables))
            slots[at] = left  # the last of those that share a slot stays
            stay = slots[at] == left
            held = np.full(_SLOTS, -1, np.int64)
            held[at[stay]] = key[left[stay]]
            self.tables.append((held, np.maximum(slots, 0)))
            left = left[~stay]
        self.merged = merged
        self.pattern = regex.compile(pattern)
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.memo, self.find = Memo(int, TOKENS), self.pattern.findall

    @staticmethod
    def _slot(key: np.ndarray, table: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED270B * table)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _ranks(self, key: np.ndarray) -> np.ndarray:
        """Rank of each pair, or ``_NONE``."""
        out = np.full(len(key), _NONE, np.int64)
        todo = np.arange(len(key))
        for k, (held, rank) in enumerate(self.tables):
            at = self._slot(key[todo], k)
            there = held[at]
            hit = there == key[todo]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit & (there >= 0)]  # a free slot: no later table has it
            if not len(todo):
                break
        return out

    def surviving(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = lengths.copy()
        ids = self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), lengths)
        rank = np.full(len(ids), _NONE, np.int64)  # of the pair that starts at each symbol
        changed = np.flatnonzero(seq[:-1] == seq[1:])
        while len(ids) > 1:
            rank[changed] = self._ranks(ids[changed] * self.size + ids[changed + 1])
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            spread = np.repeat(lowest, np.diff(np.append(first, len(ids))))
            alive = spread != _NONE
            if not alive.any():
                break
            chosen = np.flatnonzero((rank == spread) & alive)
            # in a run such as a-a-a the same pair overlaps itself: every second one applies
            run = np.append(True, np.diff(chosen) != 1)
            begin = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - begin) % 2 == 0]
            ids[chosen] = self.merged[rank[chosen]]
            out -= np.bincount(seq[chosen], minlength=len(out))
            touched = np.zeros(len(ids), bool)
            touched[chosen] = True
            touched[np.maximum(chosen - 1, 0)] = True
            alive[chosen + 1] = False  # merged into its left neighbour; finished pre-tokens leave too
            ids, seq, rank, touched = ids[alive], seq[alive], rank[alive], touched[alive]
            rank[touched] = _NONE
            changed = np.flatnonzero(touched[:-1] & (seq[:-1] == seq[1:]))
        return out

    def _counts(self, tokens: set[str]) -> dict[str, int]:
        """Symbols of each pre-token; those not met before are merged together."""
        found = {t: n for t in tokens if (n := self.memo.get(t, self.memo.old.get(t))) is not None}
        new = [t for t in tokens if t not in found]
        for at in range(0, len(new), BLOCK):
            block = new[at : at + BLOCK]
            found.update(zip(block, self.surviving([t.encode() for t in block]).tolist()))
        if len(self.memo) + len(found) > TOKENS:
            self.memo.old = dict(self.memo)
            self.memo.clear()
        self.memo.update(found)
        return found

    def _split(self, piece: str) -> list[str]:
        """Pre-tokens of a space and a piece; letters only, or letters and one mark, need no pattern."""
        if piece.isalpha():
            return [f" {piece}"]
        if piece[-1:] in MARKS and piece[:-1].isalpha():
            return [f" {piece[:-1]}", piece[-1]]
        return self.find(f" {piece}")

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text.

        A text is cut before every space that a visible character follows, where a pre-token always begins.
        """
        cut: list[tuple[list[str], list[str], int]] = []
        for text in texts:
            whole, after = [], []
            parts = self.added.split(text) if text and self.added else [text or ""]
            for p in parts:
                if LOOSE.search(p):
                    first, *rest = CUT.split(p)
                    whole += [first, *(x for x in rest if LOOSE.search(x))]
                    after += [x[1:] for x in rest if not LOOSE.search(x)]
                else:
                    first, *rest = p.split(" ")
                    whole.append(first)
                    after += rest
            cut.append(([t for x in whole for t in self.find(x)], after, len(parts) - 1))
        pieces = {p: self._split(p) for p in set().union(*(after for _, after, _ in cut))}
        known = self._counts(set().union(*pieces.values(), *(whole for whole, _, _ in cut)))
        count = {p: known[ts[0]] if len(ts) == 1 else sum([known[t] for t in ts]) for p, ts in pieces.items()}
        return [n + sum([known[t] for t in whole]) + sum([count[p] for p in after]) for whole, after, n in cut]


def read_vocabulary(path: str) -> tuple:
    """Vocabulary, merges and added tokens of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return data["model"]["vocab"], data["model"]["merges"], [t["content"] for t in data.get("added_tokens", [])]


_mergers: dict[int, RankMerger] = {}


def count_tokens(docs: DataFrame, id_col: str, text_col: str, vocabulary_path: str, pattern: str) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` of every whole text: one narrow pass without a shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    source = docs.select(F.col(id_col).alias("key"), F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if id(shared) not in _mergers:
            _mergers.clear()
            vocabulary, merges, added = shared.value
            _mergers[id(shared)] = RankMerger(vocabulary, merges, pattern, added)
        merger = _mergers[id(shared)]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                n = pa.array(merger.count(part.column(2).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), n], schema=schema)

    return source.mapInArrow(run, "key long, n_bytes long, n_tokens long").withColumnRenamed("key", id_col)
