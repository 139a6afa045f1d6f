"""Quality by co-training two views of a document.

The text view sees the words and marks of the whole text, the page-metadata view the columns beside the
text and the layout (length, lines, language, source). Both start from a bounded sample of labelled
documents (``LABELLED``); over ``ROUNDS`` rounds each gives its most confident decisions on a bounded pool
of unlabelled documents (``POOL``) to the other as pseudo-labels. Labelled documents held out of all that
calibrate each view and fit how the calibrated views combine. Every document is then scored in one pass.

Results: null texts count as empty; null metadata is a value of its own; documents repeated or without an
id are scored like any others; with fewer than eight labelled documents, or none of one kind, every score is 1
(nothing is rejected).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear

LABELLED, POOL, ROUNDS, TERMS = 3000, 2000, 3, 300
#: A document is rejected below this score (probability of good quality).
KEEP = 0.5
#: Confidence from which a view teaches the other, and documents of each class that it teaches in a round.
SURE, TAUGHT = 0.98, 200
_MARKS = re.compile(r"[^\w\s]+")


def shape(text: str, words: list[str], distinct: set[str]) -> list[float]:
    """How the words of a text look as a whole."""
    n = max(len(words), 1)
    marks = _MARKS.findall(text)
    return [
        sum(map(str.isupper, words)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(distinct) / n**0.8,
        len(marks) / n,
        sum(1 for m in marks if len(m) > 1) / n,
        sum(map(len, words)) / n / 10,
        len(set(text)) / 60,
        max(map(len, words), default=0) / 50,
    ]


def text_view(text: str | None) -> tuple[list[float], list[int]]:
    """Shape, and 64-bit hashes of the distinct words and mark runs."""
    text = text or ""
    words = text.split()
    distinct = set(words)
    marks = {f"\0{m}" for w in distinct for m in _MARKS.findall(w)}
    return shape(text, words, distinct), [xxhash.xxh64_intdigest(w) for w in distinct | marks]


def metadata_view(text: str | None, meta: list[str | None]) -> tuple[list[float], list[int]]:
    text = text or ""
    lines = text.split("\n")
    sizes = list(map(len, lines))
    layout = [np.log1p(len(text)) / 10, np.log1p(len(lines)) / 5, np.log1p(max(sizes)) / 10, len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)) / 10]
    return layout, [xxhash.xxh64_intdigest(f"{i}={m}") for i, m in enumerate(meta)]


class View:
    """A linear model over dense features and the terms that tell most about the labels."""

    def fit(self, dense: np.ndarray, terms: list, y: np.ndarray, most: int) -> View:
        n, good = len(y), y.sum()
        count: dict[int, list[int]] = {}
        for found, label in zip(terms, y):
            for t in found:
                count.setdefault(t, [0, 0])[int(label)] += 1
        rate = lambda c: abs(np.log((c[1] + 0.5) / (good + 1)) - np.log((c[0] + 0.5) / (n - good + 1))) * np.sqrt(sum(c))
        best = sorted((t for t, c in count.items() if sum(c) >= 5), key=lambda t: (-rate(count[t]), t))[:most]
        self.at = {t: i for i, t in enumerate(best)}
        self.mean, self.spread = dense.mean(axis=0), dense.std(axis=0) + 1e-6
        balance = np.where(y > 0, 0.5 / max(good, 1), 0.5 / max(n - good, 1))
        self.w = linear.logistic(self.matrix(dense, terms), y, balance, l2=1e-3)
        return self

    def matrix(self, dense: np.ndarray, terms: list) -> np.ndarray:
        out = np.zeros((len(terms), len(self.at)), np.float32)
        for i, found in enumerate(terms):
            if hit := [self.at[t] for t in found if t in self.at]:
                out[i, hit] = 1 / np.sqrt(len(hit))
        return np.hstack([np.clip((dense - self.mean) / self.spread, -5, 5), out])

    def logit(self, dense: np.ndarray, terms: list) -> np.ndarray:
        return self.matrix(dense, terms) @ self.w[:-1] + self.w[-1]


class CoTrained:
    """Both views after co-training, their calibration and their combination."""

    def __init__(self, labelled: list, y: np.ndarray, pool: list):
        held = np.arange(len(y)) % 4 == 3  # held out to calibrate and combine
        train = [x for x, h in zip(labelled, held) if not h]
        sets = [([x[v] for x in train], list(y[~held])) for v in (0, 1)]
        free = set(range(len(pool)))
        views = [self._fit(*s, v) for v, s in enumerate(sets)]
        for _ in range(ROUNDS):
            for teacher, learner in ((0, 1), (1, 0)):
                left = sorted(free)
                if not left:
                    break
                p = linear.sigmoid(self._logit(views[teacher], [pool[i][teacher] for i in left]))
                for label, sure in ((1, p), (0, 1 - p)):
                    for k in np.argsort(-sure, kind="stable")[:TAUGHT]:
                        if sure[k] >= SURE and left[k] in free:
                            free.discard(left[k])
                            sets[learner][0].append(pool[left[k]][learner])
                            sets[learner][1].append(label)
            views = [self._fit(*s, v) for v, s in enumerate(sets)]
        self.views = views
        rest = [x for x, h in zip(labelled, held) if h]
        logits = [self._logit(views[v], [x[v] for x in rest]) for v in (0, 1)]
        self.platt = [linear.logistic(l[:, None] / 4, y[held], l2=1e-4) for l in logits]
        both = np.stack([self._calibrated(v, l) for v, l in enumerate(logits)], axis=1)
        self.combine = linear.logistic(both, y[held], l2=1e-4)

    @staticmethod
    def _fit(xs: list, ys: list, v: int) -> View:
        return View().fit(np.array([x[0] for x in xs]), [x[1] for x in xs], np.array(ys, float), TERMS if v == 0 else 100)

    @staticmethod
    def _logit(view: View, xs: list) -> np.ndarray:
        return view.logit(np.array([x[0] for x in xs]), [x[1] for x in xs])

    def _calibrated(self, v: int, logit: np.ndarray) -> np.ndarray:
        return logit / 4 * self.platt[v][0] + self.platt[v][1]

    def score(self, xs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, text and metadata probabilities of good quality."""
        both = np.stack([self._calibrated(v, self._logit(self.views[v], [x[v] for x in xs])) for v in (0, 1)], axis=1)
        return linear.sigmoid(both @ self.combine[:-1] + self.combine[-1]), *linear.sigmoid(both).T


def _views(text: str | None, meta: list) -> tuple:
    return text_view(text), metadata_view(text, meta)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, meta_cols: list[str], label_col: str) -> CoTrained | None:
    """Fits on bounded samples; None without labels of both kinds."""
    meta = F.array(*(F.col(c).cast("string") for c in meta_cols)).alias("meta")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), meta)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    chosen = linear.sample(known.groupBy("id").agg(F.max("y").alias("y")), "id", LABELLED)
    learn = rows.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).orderBy("id").collect()
    y = np.array([r.y for r in learn], float)
    if len(learn) < 8 or y.min() == y.max():
        return None
    pool = linear.sample(rows.join(F.broadcast(chosen.select("id")), "id", "left_anti").where("id is not null"), "id", POOL).collect()
    return CoTrained([_views(r.text, r.meta) for r in learn], y, [_views(r.text, r.meta) for r in pool])


def _scored(docs: DataFrame, model: CoTrained | None, text_col: str, meta_cols: list[str], kept: DataFrame) -> DataFrame:
    """``kept`` (struct of columns) and the three scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    meta = F.array(*(F.col(c).cast("string") for c in meta_cols))
    place = linear.text_place(kept, text_col)
    rows = linear.carrying(docs, kept, text_col, meta.alias("meta"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if shared.value is None:
                    scores = (np.ones(part.num_rows),) * 3
                else:
                    scores = shared.value.score([_views(t, m) for t, m in zip(linear.texts(part, place), part.column(part.num_columns - 1).to_pylist())])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(s, pa.float64()) for s in scores)], names=["kept", "quality_score", "text_score", "metadata_score"])

    return rows.mapInArrow(run, f"kept {kept.schema.simpleString()}, quality_score double, text_score double, metadata_score double")


def score(docs: DataFrame, model: CoTrained | None, text_col: str, meta_cols: list[str], keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``quality_score``, ``text_score``, ``metadata_score`` of every row, in one pass."""
    kept = docs.select(*keep)
    out = _scored(docs, model, text_col, meta_cols, kept)
    return out.select(*(F.col("kept").getField(c).alias(c) for c in kept.columns), "quality_score", "text_score", "metadata_score")


def accepted(docs: DataFrame, model: CoTrained | None, text_col: str, meta_cols: list[str], threshold: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns, whatever their names."""
    out = _scored(docs, model, text_col, meta_cols, docs).where(F.col("quality_score") >= threshold)
    return out.select(*(F.col("kept").getField(c).alias(c) for c in docs.columns))
