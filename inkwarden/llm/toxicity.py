"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity has the grades 0 (not toxic) to ``GRADES``: labelled toxic documents are graded by how densely
they hold marker terms (the ``TERMS`` words and word beginnings that the labels tie most to toxicity, however
many labels there are), in equal parts. One
weight vector serves all thresholds, which are ordered by construction:
P(grade >= k) = sigmoid(w x - threshold_k). The result is the expected grade. The model is fitted on a
bounded sample of labelled documents (``LABELLED``), every whole text is scored in one pass.

Results: null texts count as empty and have no terms; repeated rows and rows without an id are scored like
any others; with no labels of both kinds the severity is 0 (nothing is rejected).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import linear
from .memo import Memo

LABELLED, GRADES, TERMS = 6000, 3, 800
#: Lengths of word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Share of toxic documents that the fit assumes; a text without any term then stays below the limit.
PRIOR = 0.12
#: A document is rejected from this probability of any toxicity on.
REJECT = 0.5
_EDGES = "".join(chr(i) for i in range(0x21, 0x7F) if not chr(i).isalnum()) + "«»„“”‚‘’…–—¿¡"


def terms(word: str) -> list[str]:
    """Features of one word: itself and its beginnings."""
    w = word.lower().strip(_EDGES)
    return [w, *(f"{w[:n]}*" for n in BEGINNINGS if len(w) > n)] if w else []


class Ordinal:
    """Cumulative-link model over counts of selected terms."""

    def __init__(self, terms_by_strength: list[str]):
        self.at = {t: i for i, t in enumerate(terms_by_strength)}

    def fit(self, counts: list[dict[int, int]], toxic: np.ndarray) -> Ordinal:
        n, bad = len(toxic), toxic.sum()
        density = np.array([c.get(-1, 0) / max(c[-2], 1) for c in counts])
        cuts = np.quantile(density[toxic > 0], [i / GRADES for i in range(1, GRADES)])
        grade = np.where(toxic > 0, 1 + np.searchsorted(cuts, density, side="right"), 0)
        x = self.matrix(counts).astype(float)
        above = grade[:, None] >= np.arange(1, GRADES + 1)[None, :]
        weight = np.where(toxic > 0, PRIOR / bad, (1 - PRIOR) / (n - bad))[:, None]
        m = x.shape[1]

        def gradient(p: np.ndarray) -> np.ndarray:
            steps = np.exp(p[m + 1 :])
            error = weight * (linear.sigmoid((x @ p[:m])[:, None] - np.append(p[m], p[m] + np.cumsum(steps))) - above)
            each = -error.sum(axis=0)
            tail = np.array([each[k + 1 :].sum() * steps[k] for k in range(len(steps))])
            return np.concatenate([x.T @ error.sum(axis=1) + 1e-4 * p[:m], [each.sum()], tail])

        p = linear.adam(gradient, np.concatenate([np.zeros(m), [1.0], np.zeros(GRADES - 1)]))
        self.w, self.thresholds = p[:m], np.append(p[m], p[m] + np.cumsum(np.exp(p[m + 1 :])))
        return self

    def matrix(self, counts: list[dict[int, int]]) -> np.ndarray:
        out = np.zeros((len(counts), len(self.at) + 2), np.float32)
        for i, c in enumerate(counts):
            for j, k in c.items():
                if j >= 0:
                    out[i, j] = np.log1p(k)
            hits = c.get(-1, 0)
            out[i, -2:] = np.log1p(hits), np.sqrt(100 * hits / max(c[-2], 1))
        return out

    def at_least(self, counts: list[dict[int, int]]) -> np.ndarray:
        """Probability of each grade or more."""
        return linear.sigmoid((self.matrix(counts) @ self.w)[:, None] - self.thresholds)


class Reader:
    """Counts of a model's terms in texts; remembers words."""

    def __init__(self, model: Ordinal):
        self.words = Memo(lambda w: tuple(model.at[t] for t in set(terms(w)) if t in model.at), 60_000)

    def counts(self, text: str | None) -> dict[int, int]:
        """Count of each term; at -1 of words that have any, at -2 of all words."""
        get, words = self.words, (text or "").split()
        hits = [h for w in words if (h := get[w])]
        out = {-2: len(words), -1: len(hits)}
        for h in hits:
            for j in h:
                out[j] = out.get(j, 0) + 1
        return out


def strongest_terms(rows: DataFrame, n: int, bad: int) -> list[str]:
    """Terms (``TERMS`` at most) of rows (``text``, ``y``) whose documents are toxic more often than all, by evidence.

    Only the order counts, so a small table has terms, too; the fit weighs weak ones. A term of a single document
    says nothing of others and is left out, unless there is just one toxic document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list({t for w in set((text or "").split()) for t in terms(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], names=["term", "y"])

    df = rows.select("text", "y").mapInArrow(run, "term string, y int").groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    base, share = bad / n, F.col("a") / (F.col("a") + F.col("b"))
    ratio = 2 * (F.col("a") * F.log(share / base) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - share) / (1 - base))).otherwise(0.0))
    strong = df.where((F.col("a") + F.col("b") >= min(2, bad)) & (share > base)).withColumn("e", F.round(ratio, 6))
    return [r.term for r in strong.orderBy(F.desc("e"), "term").limit(TERMS).select("term").collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Ordinal | None:
    """Fits on a bounded sample; None without labels of both kinds. Terms and counts are found on the executors."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    chosen = linear.sample(known.groupBy("id").agg(F.max("y").alias("y")), "id", LABELLED)
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").dropDuplicates(["id"]))
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if bad in (0, n):
        return None
    model = Ordinal(strongest_terms(rows, n, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            counts = [reader.counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(c) for c in counts], pa.list_(pa.int32())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], names=["y", "keys", "n"]
            )

    found = rows.orderBy("id").select("y", "text").mapInArrow(run, "y int, keys array<int>, n array<int>").collect()
    return model.fit([dict(zip(r[1], r[2])) for r in found], np.array([r[0] for r in found], float))


def _scored(docs: DataFrame, model: Ordinal | None, text_col: str, kept: DataFrame) -> DataFrame:
    """``kept`` (struct of columns), ``severity`` and ``toxic_probability``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = linear.text_place(kept, text_col)
    rows = linear.carrying(docs, kept, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = Reader(model) if model is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                p = model.at_least([reader.counts(t) for t in linear.texts(part, place)]) if model is not None else np.zeros((part.num_rows, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.sum(axis=1), pa.float64()), pa.array(p[:, 0], pa.float64())], names=["kept", "severity", "toxic_probability"])

    return rows.mapInArrow(run, f"kept {kept.schema.simpleString()}, severity double, toxic_probability double")


def score(docs: DataFrame, model: Ordinal | None, text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``severity`` (expected grade) and ``toxic_probability`` of every row, in one pass."""
    kept = docs.select(*keep)
    out = _scored(docs, model, text_col, kept)
    return out.select(*(F.col("kept").getField(c).alias(c) for c in kept.columns), "severity", "toxic_probability")


def accepted(docs: DataFrame, model: Ordinal | None, text_col: str, threshold: float = REJECT) -> DataFrame:
    """The rows of ``docs`` below the threshold, with their columns, whatever their names."""
    out = _scored(docs, model, text_col, docs).where(F.col("toxic_probability") < threshold)
    return out.select(*(F.col("kept").getField(c).alias(c) for c in docs.columns))
