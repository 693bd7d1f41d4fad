"""A quality classifier: ordinal cumulative-link regression on hashed text.

P(grade <= k) is the logistic function of threshold k less the text's score; all
grades share the weights and the thresholds are ordered. The score is linear in
hashed features: distinct words, and binned shares of symbols, immediate repeats
and distinct words. The expected grade ranks documents and the probability of the
top grade selects them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import lean, prepare, utf8

BITS = 18
GRADES = 3
#: The model is fitted on so many labelled documents at most (least hashes of doc_id first).
MAX_LABELLED = 12_000
#: Words of so few labelled documents carry no weight.
LEAST_SEEN = 6
THRESHOLD = 0.5
#: L1 penalties that compete; every FOLD-th labelled row judges between them.
PENALTIES = (1e-3, 3e-3, 1e-2)
FOLD = 5
_SYMBOLS = b"#$%&*|<>"


def grade(quality: Column, toxic: Column) -> Column:
    """Graded rating of a label: 0 toxic, 1 poor, 2 good. Null where nothing is known."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def _bin(kind: bytes, share: float) -> int:
    return zlib.crc32(b" %s %d" % (kind, int(10 * min(share, 1.0) ** 0.5))) & (1 << BITS) - 1


def shape(text: bytes, words: list[bytes], distinct: int) -> list[int]:
    """Hashed features of a text's shape."""
    n = len(words)
    if not n:
        return [_bin(b"empty", 0)]
    symbols = (len(text) - len(text.translate(None, _SYMBOLS))) / max(1, len(text))
    again = sum(map(eq, words, words[1:])) / n
    out = [_bin(b"symbols", 4 * symbols), _bin(b"again", again)]
    if n >= 20:
        out.append(_bin(b"distinct", distinct / min(n, 200)))
    return out


def word_feature(word: bytes) -> int:
    """A word's hashed feature, without the punctuation around it."""
    return zlib.crc32(word.strip(b".,;:!?()[]{}\"'") or word) & (1 << BITS) - 1


def features(text: bytes) -> np.ndarray:
    """Features of a whole text: one per distinct word, and its shape."""
    text = text.lower()
    words = text.split()
    distinct = set(words)
    return np.array([word_feature(w) for w in distinct] + shape(text, words, len(distinct)), np.int32)


@dataclass
class Model:
    """Weights of the hashed features and the ordered thresholds; 1 MB."""

    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) by row."""
        below = 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds, -60, 60)))
        full = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
        return np.diff(full, axis=1)


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = 200, l1: float = 1e-3, rate: float = 0.3) -> Model:
    """Adagrad on the mean log likelihood, with a proximal L1 step for the words."""
    weights, thresholds = np.zeros(1 << BITS), np.array([-1.0 + 2 * k / max(1, GRADES - 2) for k in range(GRADES - 1)])
    if not len(rows):
        return Model(weights.astype(np.float32), thresholds)
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    counts = np.bincount(flat, minlength=1 << BITS)
    used = counts[flat] >= LEAST_SEEN
    owner = np.repeat(np.arange(len(rows)), sizes)[used]
    live, flat = np.unique(flat[used], return_inverse=True)
    w, g2, t2, n = np.zeros(len(live)), np.full(len(live), 1e-8), np.full(GRADES - 1, 1e-8), len(rows)
    # Classes weigh alike, so that the rarest grade counts.
    share = np.bincount(grades, minlength=GRADES)
    cost = (n / (np.count_nonzero(share) * np.maximum(share, 1)))[grades] ** 0.5
    cost /= cost.mean()
    for _ in range(steps):
        z = np.bincount(owner, w[flat], n)
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        up, low = (1 / (1 + np.exp(np.clip(z - edges[grades + k], -60, 60))) for k in (1, 0))
        p = np.maximum(up - low, 1e-9)
        dz = cost * (up + low - 1)
        gw = np.bincount(flat, dz[owner], len(live)) / n
        gt = np.zeros(GRADES + 1)
        np.add.at(gt, grades + 1, cost * up * (1 - up) / p)
        np.add.at(gt, grades, -cost * low * (1 - low) / p)
        g2 += gw * gw
        step = rate / np.sqrt(g2)
        w += step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        gt = gt[1:-1] / n
        t2 += gt * gt
        thresholds = np.maximum.accumulate(thresholds + rate * gt / np.sqrt(t2))
    weights[live] = w
    return Model(weights.astype(np.float32), thresholds)


def choose(rows: list[np.ndarray], grades: np.ndarray, penalties: tuple[float, ...] = PENALTIES) -> float:
    """The penalty under which every FOLD-th row is likeliest, when fitted on the others."""
    held = np.arange(len(rows)) % FOLD == 0
    if len(rows) < 10 * FOLD or len(set(grades[held].tolist())) < 2:
        return penalties[0]
    learnt, judged = [r for r, h in zip(rows, held, strict=True) if not h], [r for r, h in zip(rows, held, strict=True) if h]

    def likelihood(l1: float) -> float:
        model = fit(learnt, grades[~held], steps=100, l1=l1)
        p = model.probabilities(np.array([float(model.weights[r].sum()) for r in judged]))
        return float(np.log(np.maximum(p[np.arange(len(judged)), grades[held]], 1e-9)).mean())

    return max(penalties, key=likelihood)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["grade", "features"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most ``max_labelled`` labelled rows of ``docs``."""
    prepare(docs.sparkSession)
    rated = labels.select(F.col("doc_id").cast("long").alias("_id"), grade(F.col("quality"), F.col("toxic")).cast("int").alias("grade")).where("_id is not null and grade is not null")
    chosen = rated.groupBy("_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    # Broadcast: at most `max_labelled` rows of two numbers.
    met = docs.select(F.col("doc_id").cast("long").alias("_id"), utf8("text").alias("text")).join(F.broadcast(chosen), "_id").select("grade", "text")
    rows = met.mapInArrow(lean(_featurise), "grade int, features binary").limit(2 * max_labelled).collect()
    rows.sort(key=lambda r: (zlib.crc32(r["features"]), r["grade"]))  # whatever the order in which tasks end
    features, grades = [np.frombuffer(r["features"], np.int32) for r in rows], np.array([r["grade"] for r in rows], np.int64)
    return fit(features, grades, l1=choose(features, grades))


class _Weights(dict):
    """Weight of a word, looked up by hash once per worker and word."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table

    def __missing__(self, word: bytes) -> float:
        if len(self) > 300_000:
            self.clear()
        w = self[word] = float(self.table[word_feature(word)])
        return w


def score_texts(model: Model, texts: list[bytes], memo: dict) -> np.ndarray:
    out, of = np.zeros(len(texts)), memo.__getitem__
    for k, text in enumerate(texts):
        text = text.lower()
        words = text.split()
        distinct = set(words)
        out[k] = sum(map(of, distinct)) + float(model.weights[shape(text, words, len(distinct))].sum())
    return out


SCORED = "expected_grade double, tail_probability double"


def _predict(model: Model, threshold: float):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Weights(model.weights)
        for batch in batches:
            p = model.probabilities(score_texts(model, batch.column(1).to_pylist(), memo))
            tail = p[:, -1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p @ np.arange(GRADES)), pa.array(tail), pa.array(tail >= threshold)], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    return scored


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: expected grade, probability of the top grade, verdict.

    Fitted on ``labels(doc_id, quality, toxic)``; null labels are ignored, of several
    for a doc_id the worst counts; without labels every document has the prior.
    Null texts are empty; repeated rows are scored alike; other columns are ignored.
    """
    model = train(docs, labels)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(_predict(model, threshold), f"doc_id long, {SCORED}, kept boolean")


def _select(model: Model, threshold: float):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Weights(model.weights)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            tail = model.probabilities(score_texts(model, texts, memo))[:, -1]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1])).filter(pa.array(tail >= threshold))

    return lean(kept)


def passing(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    model = train(docs, labels)
    raw = docs.select("*", utf8("text").alias("__utf8"))
    return raw.mapInArrow(_select(model, threshold), docs.schema)
