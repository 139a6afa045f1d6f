"""Near-duplicate removal: one document of each group of similar texts stays.

Two texts are linked when the Jaccard likeness of their sets of word shingles is ``likeness`` or more. One pass
makes a small sketch of every whole text: SimHash fingerprint, bands of minimum hashes, number of shingles, a
signature, and the posts of an exact join. Covering SimHash (``simhash.links``) and the bands, whose members meet
the band's smallest, put most groups together cheaply. An exact join then covers every pair of texts that these
have not put into one component: a text of n shingles posts its n - ceil(likeness n) + 1 first shingle hashes,
of which two linked texts share one. One order holds for all texts: shingles that are common in a bounded sample come
last, which only saves work. A pair is left out only where sizes, places in both posts, or signatures (each
shingle flips one bit, so differing bits are differing shingles) prove it below ``likeness``; the others are decided
on the sets of all their shingle hashes (64 bits a shingle). Only posts that several texts share go on from the first shuffle, by a bitmap of bounded
size that lets others pass only by chance. Up to ``FEW`` texts of one hash give their pairs. Of more only a forest of
the possible pairs leaves the task: texts that it connects are one cluster, wider signatures part it again, and what
is left meets with whole sets, block by block, each text once a block; again a forest of the links leaves the task, so
no step makes rows by the square of a group's size. Of each component the text with the smallest document id stays.

Results: null and blank texts are one group; exact copies are one group; of repeated rows one stays; a document
without an id stays only where its group has none with one. Columns are those of the input. Texts are named by 64
bits of a 128-bit hash, and where two texts share these, by all of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, partitions, remove, shared_path
from . import simhash
from .memo import Memo

SHINGLE, LIKENESS, BANDS, ROWS = 5, 0.8, 8, 4
#: How much wider than those that go with posts the signatures are that sieve pairs.
WIDE = 8
#: Texts of a block; larger groups are compared by pairs of blocks. Texts of one hash whose pairs are listed.
BLOCK, FEW = 1024, 8
#: Texts that tell which shingles are common, at most; texts counted at once; common shingles, at most.
SAMPLE, TOGETHER, COMMON = 32_000, 2000, 100_000
#: Rows of a table of two numbers that may be broadcast; larger ones are shuffled. Bits (as a power of two) of a bitmap.
SMALL, MOST_BITS = 1_000_000, 26
#: Edges whose components the driver finds (16 bytes each); more are solved on the executors.
EDGES = 100_000
#: Words whose hash a worker remembers.
WORDS = 60_000
_RNG = np.random.default_rng(2024)
_FACTOR = _RNG.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TAPS = (0, 19, 38)


def shingles(text: str | None, k: int = SHINGLE) -> list[bytes]:
    words = (text or "").encode().lower().split()
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


class Shingler:
    """Hashes of the word shingles of texts; remembers words."""

    def __init__(self, k: int = SHINGLE):
        self.k, self.words = k, Memo(xxhash.xxh64_intdigest, WORDS)

    def hashes(self, text: str | None) -> np.ndarray:
        """A hash for each shingle in its place, repeats included."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = (out ^ h[i : i + len(out)]) * _MIX
            out ^= out >> np.uint64(29)
        return out


def bands(h: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of minimum hashes of a set."""
    if not len(h):
        return [0] * BANDS
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        mixed = h[at : at + 4096, None] * _FACTOR[None, :] + _SHIFT[None, :]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
    packed = least.astype("<u8").tobytes()
    step = 8 * ROWS
    return [xxhash.xxh64_intdigest(packed[i * step : (i + 1) * step], i) - (1 << 63) for i in range(BANDS)]


def signature(h: np.ndarray, times: int = 1) -> bytes:
    """A set's bits, each flipped once for every hash that falls on it: ``times`` the power of two up to its size, 64 at least."""
    width = times * (64 << max(0, len(h).bit_length() - 7))
    odd = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def posts(h: np.ndarray, likeness: float = LIKENESS, common: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Posted hashes of a sorted set, in the order of all texts: smallest first, but ``common`` ones (sorted, and how
    common they are) last. A text without words posts 0."""
    n = len(h)
    if n and common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
        h = h[np.lexsort((h, np.where(common[0][at] == h, common[1][at], 0)))]
    return (h[: n - math.ceil(likeness * n - 1e-9) + 1] if n else np.zeros(1, np.uint64)).view(np.int64)


def _common(keyed: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes that several texts of a sample hold, in order, and the length in bits of how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sets = Shingler(), []

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            sets.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["key", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                sets.append(np.unique(shingler.hashes(text)))
                if len(sets) == TOGETHER:
                    yield counted()
        yield counted()

    one_of = max(1, -(-keyed.count() // SAMPLE))
    texts = keyed.where(F.pmod("__k2", F.lit(one_of)) == 0).select(F.col(text_col).alias("text"))
    found = texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 3").orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    keys, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], np.array([int(x).bit_length() for x in n[order]], np.int8)


def text_hash(text: Column, part: int) -> Column:
    """One of the two 64-bit halves of a text's name."""
    return F.xxhash64(text, F.lit(part))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``__k1`` and ``__k2``, both halves of the name of the row's text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"__k1": text_hash(text, 1), "__k2": text_hash(text, 2)})


def _named(rows: DataFrame, clashing: DataFrame | None, name: str = "tk") -> DataFrame:
    """Adds ``name``, one long for each text: its first half, or where other texts share that, a hash of both."""
    if clashing is None:
        return rows.withColumn(name, F.col("__k1"))
    marked = rows.join(F.broadcast(clashing.withColumn("__clash", F.lit(True))), "__k1", "left")
    return marked.withColumn(name, F.when(F.col("__clash"), F.xxhash64("__k1", "__k2")).otherwise(F.col("__k1"))).drop("__clash")


def _sketches(docs: DataFrame, id_col: str, text_col: str, likeness: float) -> DataFrame:
    names = ["id", "__k1", "__k2", "fp", "n", "sig", "wide", "bands", "posted"]
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                fp, n, sig, wide, band, posted = [], [], [], [], [], []
                for text in part.column(3).to_pylist():
                    every = shingler.hashes(text)
                    h = np.unique(every)
                    fp.append(simhash.majority(every) if len(every) else 0)
                    n.append(len(h))
                    sig.append(signature(h))
                    wide.append(signature(h, WIDE))
                    band.append(bands(h))
                    posted.append(posts(h, likeness, common.value))
                ends = pa.array(np.append(0, np.cumsum([len(p) for p in posted])).astype(np.int32))
                columns = [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(wide, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(posted)))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *columns], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), "__k1", "__k2", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, __k1 long, __k2 long, fp long, n int, sig binary, wide binary, bands array<long>, posted array<long>")


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, marked for broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def _met(rows: DataFrame, by: list[str]) -> DataFrame:
    """Candidates: each member of a group with the group's smallest."""
    least = rows.groupBy(*by).agg(F.min("tk").alias("a"), F.max("tk").alias("hi")).where("a <> hi").drop("hi").repartition(partitions(rows.sparkSession))
    return rows.join(least, by).where("tk <> a").select("a", F.col("tk").alias("b"))


def _folded(sigs: list[bytes], width: int) -> np.ndarray:
    """Signatures as rows of 64-bit words, each folded to ``width`` bytes."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, "<u8").reshape(-1, width // 8), axis=0) for s in sigs])


def _forest(members: list[dict], cross: bool, likeness: float) -> list[tuple[int, int]]:
    """A forest of the pairs of texts that are in two components and not proven below ``likeness``: it connects the
    same texts as all such pairs do.

    With ``cross`` only pairs of two blocks. Under one hash it can be the first one that a linked pair shares only
    where enough of both texts is left behind it; a pair fails here but not under its first shared hash.
    """
    members = sorted(members, key=lambda r: r["n"])
    tk, n, pos, comp, own = (np.array([r[c] for r in members], np.int64) for c in ("tk", "n", "pos", "comp", "own"))
    widths = np.array([len(r["sig"]) for r in members])
    folded = {int(w): _folded([r["sig"] for r in members[int(np.argmax(widths >= w)) :]], int(w)) for w in np.unique(widths)}
    end = np.searchsorted(n, np.floor(n / likeness + 1e-9), side="right")  # n is in order, and so are widths
    share, out, tree = likeness / (1 + likeness), [], np.arange(len(members))
    for i in range(len(members) - 1):
        j = np.arange(i + 1, end[i])
        both = n[i] + n[j]
        fit = (tree[j] != tree[i]) & (comp[j] != comp[i]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= share * both - 1e-9)
        if cross:
            fit &= own[j] != own[i]
        j = j[fit]
        if len(j):
            w = int(widths[i])
            at, sigs = int(np.argmax(widths >= w)), folded[w]
            apart = np.bitwise_count(sigs[j - at] ^ sigs[i - at]).sum(axis=1, dtype=np.int64)
            out += _joined(tree, tk, i, j[apart <= (1 - 2 * share) * (n[i] + n[j]) + 1e-9])
    return out


def _joined(tree: np.ndarray, tk: np.ndarray, i: int, near: np.ndarray) -> list[tuple[int, int]]:
    """Edges from ``i`` to one text of each tree that ``near`` meets; these become one tree."""
    if not len(near):
        return []
    met, first = np.unique(tree[near], return_index=True)
    edges = [(int(min(tk[i], tk[x])), int(max(tk[i], tk[x]))) for x in near[first[met != tree[i]]]]
    tree[np.isin(tree, met)] = tree[i]
    return edges


def _set_forest(members: list[dict], cross: bool, likeness: float) -> list[tuple[int, int]]:
    """A forest of the links between components, decided on whole sets (``sig`` has the hashes)."""
    tk, n, comp, own = (np.array([r[c] for r in members], np.int64) for c in ("tk", "n", "comp", "own"))
    hashes = np.concatenate([np.frombuffer(r["sig"], np.uint64) for r in members])
    _, place = np.unique(hashes, return_inverse=True)
    starts = np.append(0, np.cumsum(n)[:-1])  # only sets with members come here
    held, out, tree = np.zeros(len(hashes), bool), [], np.unique(comp, return_inverse=True)[1]
    for i in range(len(members) - 1):
        j = np.arange(i + 1, len(members))
        j = j[(tree[j] != tree[i]) & (np.minimum(n[j], n[i]) >= likeness * np.maximum(n[j], n[i]) - 1e-9)]
        if cross:
            j = j[own[j] != own[i]]
        if len(j):
            mine = place[starts[i] : starts[i] + n[i]]
            held[mine] = True
            both = np.add.reduceat(held[place], starts, dtype=np.int64)[j] if 4 * len(j) > len(members) else np.array([held[place[starts[x] : starts[x] + n[x]]].sum() for x in j])
            held[mine] = False
            out += _joined(tree, tk, i, j[both >= likeness * (n[i] + n[j] - both) - 1e-9])
    return out


def _dealt(rows: DataFrame, several: DataFrame, forest: Callable, likeness: float) -> DataFrame:
    """Edges ``a`` < ``b`` that ``forest`` finds among the rows (tk, n, pos, comp, sig) of each ``key`` of ``several``
    (key, blocks): within a block, and between any two."""
    rows = rows.join(several, "key").withColumn("own", F.pmod(F.xxhash64("tk", F.lit(7)), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = rows.groupBy("key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")).agg(F.collect_list(F.struct("tk", "n", "pos", "comp", "own", "sig")).alias("members"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                found |= {p for c, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for p in forest(m, c, likeness)}
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return groups.where(F.size("members") > 1).select((F.col("one") != F.col("two")).alias("cross"), "members").mapInArrow(compared, "a long, b long").distinct()


def _components(edges: DataFrame) -> DataFrame:
    """``simhash.components`` without its rounds of shuffles where edges are few."""
    edges = cut(edges)
    if edges.count() > EDGES:
        return simhash.components(edges)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    found = edges.select("a", "b").toArrow()
    for a, b in zip(found.column("a").to_pylist(), found.column("b").to_pylist()):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    nodes = [x for x in parent if find(x) != x]
    tree = pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([find(x) for x in nodes], pa.int64())})
    return edges.sparkSession.createDataFrame(tree)


def _clusters(edges: DataFrame) -> DataFrame:
    """``tk``, ``key``: the texts that ``edges`` connect, and the smallest text of each cluster."""
    tree = _components(edges)
    return cut(tree.select(F.col("node").alias("tk"), F.col("root").alias("key")).unionByName(tree.select(F.col("root").alias("tk"), F.col("root").alias("key"))).distinct())


def _blocks(rows: DataFrame) -> DataFrame:
    """``key``, ``blocks`` of every key of ``rows``."""
    return rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))


def _apart(a: bytes, b: bytes) -> int:
    """Differing bits of two signatures, the longer one folded: at most so many shingles differ, at least."""
    w = min(len(a), len(b))
    x, y = (_folded([s], w)[0] for s in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def _asked(pairs: DataFrame) -> DataFrame:
    """``tk``: the texts of some pairs."""
    return cut(pairs.select(F.col("a").alias("tk")).unionByName(pairs.select(F.col("b").alias("tk"))).distinct())


def _likely(pairs: DataFrame, seen: DataFrame, likeness: float) -> DataFrame:
    """Pairs that sizes and signatures don't prove below ``likeness``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, m, n, s, t = (c.to_pylist() for c in batch.columns)
            keep = [i for i in range(len(a)) if min(m[i], n[i]) >= likeness * max(m[i], n[i]) - 1e-9 and _apart(s[i], t[i]) <= (1 - likeness) / (1 + likeness) * (m[i] + n[i]) + 1e-9]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    pairs = cut(pairs)
    sketches = cut(seen.select("tk", "n", "wide").join(_small(_asked(pairs)), "tk", "left_semi").dropDuplicates(["tk"]))
    side = lambda c: sketches.select(F.col("tk").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(run, "a long, b long")


def _sets(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``tk``, ``h``: all shingle hashes of the texts (``tk``, ``text``) that ``asked`` names."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            packed = [np.unique(shingler.hashes(t)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["tk", "h"])

    # copies are combined by each task before the shuffle, so that a much copied text stays small there
    texts = rows.join(_small(asked), "tk", "left_semi").groupBy("tk").agg(F.first("text").alias("text"))
    return cut(texts.select("tk", "text").mapInArrow(sets, "tk long, h binary"))


def _linked(rows: DataFrame, pairs: DataFrame, likeness: float) -> DataFrame:
    """The candidates whose whole texts (``tk``, ``text``) are alike."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                h, g = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(h, g, assume_unique=True))
                if both >= likeness * (len(h) + len(g) - both) - 1e-9:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    pairs = cut(pairs)
    hashed = _sets(rows, _asked(pairs))
    side = lambda c: hashed.select(F.col("tk").alias(c), F.col("h").alias(f"h_{c}"))
    return cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "h_a", "h_b").mapInArrow(alike, "a long, b long"))


def _bitmap(keys: DataFrame, n: int) -> np.ndarray:
    """64-bit words of a bitmap that holds three bits of each key, at most 2 ** ``MOST_BITS`` bits whatever ``n``."""
    bits = min(MOST_BITS, max(16, (12 * n).bit_length()))
    places = F.explode(F.array(*(F.shiftrightunsigned("key", t).bitwiseAND(F.lit((1 << bits) - 1)) for t in _TAPS)))
    word = keys.select(places.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("x"))
    found = word.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("w").to_numpy()] = found.column("x").to_numpy().view(np.uint64)
    return out


def _holds(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    mask, out = np.uint64(64 * len(words) - 1), np.ones(len(keys), bool)
    for t in _TAPS:
        at = (keys.view(np.uint64) >> np.uint64(t)) & mask
        out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _stored(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` as a table in the shared folder, smaller there than a checkpoint."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _rest(rows: DataFrame, seen: DataFrame, tree: DataFrame, likeness: float, folder: str) -> DataFrame:
    """Links that connect all texts that are linked but in two components of ``tree``."""
    spark = seen.sparkSession
    shared = seen.select("tk", F.explode("posted").alias("key")).groupBy("key").agg(F.min("tk").alias("lo"), F.max("tk").alias("hi")).where("lo <> hi").select("key")
    shared = cut(shared)
    words = spark.sparkContext.broadcast(_bitmap(shared, shared.count()))
    names = ["tk", "n", "pos", "key"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, keys = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            ends, keys = ends - ends[0], keys[ends[0] : ends[-1]]
            at = np.flatnonzero(_holds(words.value, keys))
            row = np.searchsorted(ends, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array((at - ends[row]).astype(np.int32)), pa.array(keys[at])], names=names)

    known = tree.select(F.col("node").alias("tk"), "root")
    posted = seen.select("tk", "n", "posted").mapInArrow(placed, "tk long, n int, pos int, key long")
    posted = posted.groupBy("tk", "key").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))  # copies post the same
    posted = _stored(posted.join(known, "tk", "left").withColumn("comp", F.coalesce("root", "tk")).drop("root"), f"{folder}/posted")
    several = cut(posted.groupBy("key").agg(F.count(F.lit(1)).alias("of"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "of"))
    few = posted.join(several.where(F.col("of") <= FEW), "key").groupBy("key").agg(F.collect_list(F.struct("tk", "n", "pos", "comp")).alias("m"))
    share = likeness / (1 + likeness)
    both = f"x.comp <> y.comp and least(x.n - x.pos, y.n - y.pos) >= {share}D * (x.n + y.n) - 1e-9D"
    pairs = F.expr(f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> {both}), y -> struct(least(x.tk, y.tk) as a, greatest(x.tk, y.tk) as b))))")
    pairs = few.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()
    links = _linked(rows, _likely(pairs, seen, likeness), likeness)

    # groups of more: clusters by the signatures, parted by wider ones, then decided on whole sets
    many = cut(posted.join(several.where(F.col("of") > FEW).select("key"), "key"))
    if many.isEmpty():
        return links
    signed = seen.select("tk", "sig").join(_small(cut(many.select("tk").distinct())), "tk", "left_semi").dropDuplicates(["tk"])
    edges = _dealt(many.join(signed, "tk"), _blocks(many), _forest, likeness)
    of = cut(many.select("tk", "comp").distinct())
    for wide in (True, False):
        named = _clusters(edges)
        if named.isEmpty():
            return links
        if wide:
            held = seen.select("tk", F.col("n"), F.col("wide").alias("sig")).join(_small(named.select("tk")), "tk", "left_semi").dropDuplicates(["tk"])
        else:
            held = _sets(rows, named.select("tk")).select("tk", (F.octet_length("h") / 8).cast("int").alias("n"), F.col("h").alias("sig"))
        held = held.join(named, "tk").join(of, "tk").withColumn("pos", F.lit(0))
        edges = cut(_dealt(held, _blocks(named), _forest if wide else _set_forest, likeness))
    return links.unionByName(edges)


def deduplicate(docs: DataFrame, id_col: str, text_col: str, likeness: float = LIKENESS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates."""
    spark = docs.sparkSession
    keyed = _keyed(docs, text_col)
    folder = shared_path(spark, "near-dedup")
    seen = _stored(_sketches(keyed, id_col, text_col, likeness), f"{folder}/seen")
    clashing = cut(seen.groupBy("__k1").agg(F.min("__k2").alias("lo"), F.max("__k2").alias("hi")).where("lo <> hi").select("__k1"))
    clashing = None if clashing.isEmpty() else clashing
    seen = _named(seen, clashing)
    first = cut(seen.groupBy("tk", "id").agg(F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp")))
    nodes = cut(first.groupBy("tk").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("top"), F.first("fp").alias("fp")))
    same = nodes.select("tk", "fp")
    speaker = same.groupBy("fp").agg(F.min("tk").alias("tk"))
    fp_links = simhash.links(speaker.select("fp"))
    said = lambda c: speaker.select(F.col("fp").alias(f"fp_{c}"), F.col("tk").alias(c))
    near = fp_links.select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(said("a"), "fp_a").join(said("b"), "fp_b").select("a", "b")
    banded = seen.select("tk", F.posexplode("bands").alias("band", "key")).distinct()
    pairs = _met(banded, ["band", "key"]).unionByName(_met(same, ["fp"])).unionByName(near)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = _named(keyed.select("__k1", "__k2", F.coalesce(F.col(text_col), F.lit("")).alias("text")), clashing).select("tk", "text")
    edges = _linked(rows, _likely(pairs, seen, likeness), likeness)
    rest = _rest(rows, seen, _components(edges), likeness, folder)
    tree = _components(edges.unionByName(rest))
    rooted = nodes.select("tk", "top").join(tree.select(F.col("node").alias("tk"), "root"), "tk", "left").select("tk", "top", F.coalesce("root", "tk").alias("root"))
    kept = cut(rooted.groupBy("root").agg(F.min(F.struct("top", "tk")).alias("best")).select("best.tk", F.col("best.top.id").alias("id"), (F.col("best.top.n") > 1).alias("again")))
    once = kept.where("not again").select(F.col("tk").alias("__tk"), F.col("id").alias("__kept"))
    gone = cut(first.select("tk", "id").alias("f").join(once.alias("o"), (F.col("f.tk") == F.col("o.__tk")) & F.col("f.id").eqNullSafe(F.col("o.__kept")), "left_anti").select(F.col("f.tk").alias("__tk"), F.col("f.id").alias("__gone")))
    again = cut(kept.where("again").select(F.col("tk").alias("__tk"), F.col("id").alias("__kept")))
    remove(spark, folder)
    every = _named(keyed, clashing, "__tk")
    own = every[id_col].cast("long")
    single = every.join(_small(gone), (every["__tk"] == gone["__tk"]) & own.eqNullSafe(gone["__gone"]), "left_anti").select(*docs.columns)
    if again.isEmpty():
        return single
    repeated = every.join(_small(again), (every["__tk"] == again["__tk"]) & own.eqNullSafe(again["__kept"]), "left_semi").dropDuplicates(["__tk"]).select(*docs.columns)
    return single.unionByName(repeated)
