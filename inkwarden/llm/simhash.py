"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is the majority over the shingles' hashes. To find all pairs within ``radius`` bits, each
bit position is given a vector of ``radius + 1`` bits; table ``v`` keeps the positions whose vector has an
odd product with ``v``. For any ``radius`` differing positions some non-zero ``v`` is orthogonal to all their
vectors, so every such pair has equal kept bits, and collides, in some table. Groups above ``GROUP`` are
covered again over the bits left free; after three levels a group has at most 256 members. Inside a group
only a spanning forest of the true links leaves the task, so no link between components is lost and no
group's pairs are emitted.

Results: null texts count as empty; texts without words have fingerprint zero and link like any other;
equal texts share a fingerprint; repeated rows repeat in the result; rows without an id take part, and the
component of a fingerprint that only such rows have is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, partitions

#: Members of a group that one task compares; larger groups are covered again.
GROUP = 512
#: Parts in which the members of a component meet its root.
SALTS = 64
_BLOCK, _ALL = 65536, (1 << 64) - 1


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """64-bit SimHash over the word shingles of one whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())), "<u8", len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint's bits as a signed long) of every row, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions that cover all sets of ``radius`` of them."""
    width = 1 << (radius + 1)
    if len(bits) * 2 <= width:  # fewer positions than vectors: take the odd ones, so that none is zero
        vectors = [(2 * i + 1) % width for i in range(len(bits))]
    else:
        vectors = [i % width for i in range(len(bits))]
    return [sum(1 << b for b, m in zip(bits, vectors) if (m & v).bit_count() % 2) for v in range(1, width)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bits(x: int) -> list[int]:
    return [i for i in range(64) if x >> i & 1]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within one group."""
    if len(fps) == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= radius else []
    left, out = np.arange(len(fps)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= radius
            found = left[near].tolist()
            out += [(i, j) for j in found]
            queue += found
            left = left[~near]
    return out


def _group_links(groups: DataFrame, radius: int) -> DataFrame:
    """``a``, ``b``: forest edges of groups given as ``fps`` (bounded arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0).to_pylist():
                fps = np.array(members, np.int64).view(np.uint64)
                for i, j in _forest(fps, radius):
                    a.append(min(members[i], members[j]))
                    b.append(max(members[i], members[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.select("fps").mapInArrow(run, "a long, b long")


def _covered(kept: dict[int, int], radius: int) -> list[tuple[int, int, int]]:
    """(chain, next chain, kept bits): every chain of tables goes on with masks over the bits it leaves free."""
    out = []
    for chain, bits in kept.items():
        masks = covering_masks(_bits(_ALL & ~bits), radius)
        out += [(chain, chain * (len(masks) + 1) + v + 1, bits | m) for v, m in enumerate(masks)]
    return out


def links(fps: DataFrame, radius: int = 4, group: int = GROUP) -> DataFrame:
    """Forest edges ``a`` < ``b`` that connect the same fingerprints as all pairs within ``radius`` do.

    ``fps`` has distinct fingerprints in column ``fp``.
    """
    spark = fps.sparkSession
    step = _covered({0: 0}, radius)
    tables = F.array(*(F.struct(F.lit(c).alias("chain"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for _, c, m in step))
    keyed = fps.select("fp", F.explode(tables).alias("k")).select("fp", "k.chain", "k.key")
    found = None
    for level in range(3):
        several = cut(keyed.groupBy("chain", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        members = cut(keyed.join(several, ["chain", "key"]))
        small = members if level == 2 else members.where(F.col("n") <= group)
        edges = cut(_group_links(small.groupBy("chain", "key").agg(F.collect_list("fp").alias("fps")), radius).distinct())
        found = edges if found is None else found.unionByName(edges)
        large = members.where(F.col("n") > group)
        if level == 2 or large.isEmpty():
            break
        step = _covered({c: m for _, c, m in step}, radius)
        masks = spark.createDataFrame([(c, d, _signed(m)) for c, d, m in step], "chain int, next int, mask long")  # 31 * 31 or 31 ** 3 rows
        keyed = large.join(F.broadcast(masks), "chain").select("fp", F.col("next").alias("chain"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    return found


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: connected components of edges ``a`` < ``b``, by alternating large and small stars.

    A large star links each node's larger neighbours to its smallest, a small star its smaller ones; every
    round is written to the shared folder, and only two numbers reach the driver.
    """
    state, n = None, partitions(edges.sparkSession)
    edges = cut(edges.where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # dealt anew before the join, so that a hub's rows can be split
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).repartition(n)
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m")).repartition(n)
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("a"), "b").unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        edges = cut(small)
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(row) == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = tuple(row)


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    tree = components(links(distinct.select("fp"), radius))
    linked = tree.select(F.col("node").alias("fp"), "root").unionByName(tree.select(F.col("root").alias("fp"), "root")).distinct()
    linked = cut(linked.join(distinct, "fp"))
    # a root may hold a third of all fingerprints: dealt by salt, each part meets a copy of the root's row
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(roots, ["root", "salt"]).select("fp", "component_id")
    alone = distinct.join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return rows.join(cut(named.unionByName(alone)), "fp").select(F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
