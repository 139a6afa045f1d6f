"""Exact top-k inner products over an impact-ordered index, score at a time.

Components become integers (``floor(scale * x)``). A block of rows is indexed by impact: the postings (row)
of a dimension whose components share one quantised impact (sign and the leading bits of the size) are a
segment. A batch of queries takes the segments in falling order of impact, each segment once for the whole
batch. What the segments taken so far leave of a row is a vector of known length, so that the row's score
lies within that length times the query's of the sum so far. A row leaves when its upper bound lies below
the k-th best lower bound; a query stops as soon as few rows are left for it. All that are left are rescored
exactly. Components below the smallest impact are in no segment and count only in rescoring.

Rows and queries meet in blocks of bounded size, and only k rows of a block pair go on.

Results: vectors that are null or hold null or non-finite components, and rows without an id, take no part;
a shorter vector counts as filled up with zeros; rows with a query's own id are no candidates of it; of
repeated query ids the one with the smallest vector asks; ties go to the smaller id, then repeat. Components
too large for 64-bit sums are rescored in Python's unbounded integers; a score among the best that doesn't
fit a long raises ``OverflowError``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

ROWS, QUERIES, BATCH = 16384, 32768, 256
#: Leading bits of a component's size that tell its impact, and rows left of a query, times k, at which it stops.
BITS, FEW = 6, 4
#: Components from here on are left out of segments: their rows are always rescored.
LARGE = 1 << 24
_LONG = 1 << 63


class ImpactIndex:
    """Posting segments of a block of integer vectors, by falling impact."""

    def __init__(self, values: np.ndarray, bits: int = BITS):
        n, width = values.shape
        self.values, self.n = values, n
        size = np.abs(values)
        self.large = (size >= LARGE).any(axis=1) if n else np.zeros(0, bool)
        small = np.where(self.large[:, None], 0, size).astype(np.int64)
        span = int(small.max()) if small.size else 0
        self.shift = max(0, span.bit_length() - bits)
        level = small >> self.shift
        row, dim = np.nonzero(level)
        self.postings = len(row)
        impact = np.where(values[row, dim] < 0, -1, 1) * ((level[row, dim] << self.shift) + ((1 << self.shift) >> 1)).astype(np.int64)
        order = np.lexsort((row, impact, dim, -np.abs(impact)))
        self.row, dim, impact = row[order], dim[order], impact[order]
        new = np.flatnonzero(np.append(True, (dim[1:] != dim[:-1]) | (impact[1:] != impact[:-1]))) if len(order) else np.zeros(0, int)
        self.segments = list(zip(new.tolist(), np.append(new[1:], len(order)).tolist(), dim[new].tolist(), impact[new].tolist()))
        # squared length of what is left of each row behind every check
        self.left = [(small.astype(float) ** 2).sum(axis=1)]
        self.checks: list[tuple[int, int]] = [(0, 0)]  # segments and postings taken before each check
        at, taken = 0, 0
        for share in (0.5, 0.75, 1.0):
            while at < len(self.segments) and taken < share * self.postings:
                taken, at = self.segments[at][1], at + 1
            if at > self.checks[-1][0]:
                begin = self.checks[-1][1]
                r, d, i = self.row[begin:taken], dim[begin:taken], np.abs(impact[begin:taken]).astype(float)
                was = small[r, d].astype(float)
                self.left.append(self.left[-1] + np.bincount(r, (was - i) ** 2 - was**2, n))
                self.checks.append((at, taken))
        self.touched = self.rescored = 0

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list]:
        """Positions of queries and rows, and scores, of each query's k best rows."""
        if not self.n or not len(queries):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), []
        by_id = np.argsort(ids, kind="stable")
        first, last = np.searchsorted(ids[by_id], own, "left"), np.searchsorted(ids[by_id], own, "right")
        wide = (np.abs(queries) >= LARGE).any(axis=1)  # rescored against all rows
        possible = np.ones((self.n, len(queries)), bool)
        for q in range(len(queries)):
            possible[by_id[first[q] : last[q]], q] = False
        going = np.flatnonzero(~wide)
        asked = np.ascontiguousarray(queries[going].T.astype(np.float32))
        length = np.sqrt((queries[going].astype(float) ** 2).sum(axis=1)) * (1 + 1e-6)
        total = np.zeros((self.n, len(going)), np.float32)
        rounding = 2e-7 * (len(asked) + 1) * np.sqrt(self.left[0])  # of single precision sums, a unit of the query's length
        for (begin, taken), (end, stop), left in zip(self.checks, self.checks[1:], self.left[1:]):
            if not len(going):
                break
            for a, b, dim, impact in self.segments[begin:end]:
                total[self.row[a:b]] += np.float32(impact) * asked[dim]
            self.touched += (stop - taken) * len(going)
            reach = (np.sqrt(np.maximum(left, 0) * (1 + 1e-6) + 1) + rounding).astype(np.float32)
            slack = reach[:, None] * (length + 1).astype(np.float32)[None, :]
            now = possible[:, going]
            if self.n > k:
                low = np.where(now & ~self.large[:, None], total - slack, np.float32(-np.inf))
                bar = np.partition(np.ascontiguousarray(low.T), self.n - k, axis=1)[:, self.n - k]
                now &= (total + slack >= bar[None, :]) | self.large[:, None]
                possible[:, going] = now
            more = now.sum(axis=0) > FEW * k
            if not more.all():
                going, asked, length, total = going[more], np.ascontiguousarray(asked[:, more]), length[more], np.ascontiguousarray(total[:, more])
        q, r = np.nonzero(possible.T)
        self.rescored += len(q)
        score = self._exact(queries, q, r)
        order = np.lexsort((ids[r], -score, q)) if score.dtype != object else np.array(sorted(range(len(q)), key=lambda x: (q[x], -score[x], ids[r[x]])), np.int64)
        q, r, score = q[order], r[order], score[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], r[keep], score[keep].tolist()

    def _exact(self, queries: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Exact scores of pairs; in unbounded integers where 64 bits could overflow."""
        most = int(np.abs(queries).max(initial=0)) * int(np.abs(self.values).max(initial=0)) * max(1, queries.shape[1])
        if most >= _LONG:
            a, b = queries.astype(object), self.values.astype(object)
            return np.array([int((a[i] * b[j]).sum()) for i, j in zip(q, r)], object)
        out = np.empty(len(q), np.int64)
        for at in range(0, len(q), 65536):
            part = slice(at, at + 65536)
            out[part] = np.einsum("ij,ij->i", queries[q[part]], self.values[r[part]])
        return out


def integers(vectors: pa.ListArray, scale: int) -> tuple[np.ndarray, list[bytes]]:
    """Rows whose components are all finite, and their whole components, as doubles, packed."""
    x = np.floor(scale * vectors.values.to_numpy(zero_copy_only=False).astype("<f8"))  # nulls become NaN
    ends, odd = vectors.offsets.to_numpy(), np.append(0, np.cumsum(~np.isfinite(x)))
    good = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False) & (odd[ends[1:]] == odd[ends[:-1]]))
    return good, [x[ends[i] : ends[i + 1]].tobytes() for i in good]


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers; of Python's integers if one doesn't fit."""
    out = np.zeros((len(packed), width))
    for i, p in enumerate(packed):
        v = np.frombuffer(p, "<f8")
        out[i, : len(v)] = v
    if out.size and np.abs(out).max() >= float(1 << 62):
        return np.array([[int(x) for x in row] for row in out], object).reshape(out.shape)
    return out.astype(np.int64)


def _packed(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, packed = integers(batch.column(1), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(packed, pa.binary()), batch.column(2).take(pa.array(good))], names=["id", "v", "asks"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    return rows.where("id is not null and v is not null").mapInArrow(run, "id long, v binary, asks boolean")


def top_k(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``."""
    rows = cut(_packed(vectors, id_col, vector_col, is_query, scale))
    n, asks = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    row_blocks, query_blocks = max(1, -(-n // ROWS)), max(1, -(-asks // QUERIES))
    # of repeated ids the smallest vector asks; no order of bytes is one of numbers, so Python picks it
    asked = rows.where("asks").groupBy("id").agg(F.collect_set("v").alias("vs"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(row_blocks)).cast("int").alias("rb"), every(query_blocks).alias("qb"))
    asking = asked.select("id", "vs", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("qb"), every(row_blocks).alias("rb"))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = left.column("id").to_numpy(), right.column("id").to_numpy()
        data, asks = left.column("v").to_pylist(), [min(vs, key=lambda p: np.frombuffer(p, "<f8").tolist()) for vs in right.column("vs").to_pylist()]
        width = max(map(len, [*data, *asks]), default=0) // 8
        index, out = ImpactIndex(_matrix(data, width)), ([], [], [])
        for at in range(0, len(asks), BATCH):
            part = own[at : at + BATCH]
            q, r, s = index.search(_matrix(asks[at : at + BATCH], width), part, ids, k)
            if any(abs(x) >= _LONG for x in s):
                raise OverflowError("a score among the best doesn't fit a long")
            for column, values in zip(out, (part[q].tolist(), ids[r].tolist(), s)):
                column += values
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), out)})

    found = dealt.groupBy("rb", "qb").cogroup(asking.groupBy("rb", "qb")).applyInArrow(pair, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
