"""Quality classifier: support vectors on Naive Bayes features.

A text's features are indicators of its byte n-grams up to three (hashed to `BUCKETS`) and of runs
of a repeated word (an n-gram of equal words, whatever the word). Each indicator is scaled by the
logarithm of the ratio of its frequencies in the two classes, rows are brought to length one, and a
linear model with hinge loss is fit by dual coordinate descent. Margins become scores by a logistic
curve fit to the same rows.

The fit uses at most `SAMPLE` labelled rows per class, those with the smallest digests of their ids.
Scores read whole texts and nothing else. Null and empty texts have no features and get the score of
the intercept. With no labelled rows of one class every score is 1 (or 0) as the other class says,
and 0.5 without any. Conflicting labels of a document count as the larger one; labels other than 0
and 1 do not count. Extra columns are not read.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backuplake.llm.language import drawn
from backuplake.session import pin

BUCKETS = 1 << 17
#: Run lengths of a repeated word that have a feature; their places follow the buckets.
RUNS = (2, 3, 4, 8)
FEATURES = BUCKETS + len(RUNS)
SAMPLE = 2000
COST = 4.0
EPOCHS = 30
SMOOTHING = 1.0

_seat: list[np.ndarray] = []


def longest_run(words: list[str]) -> int:
    """Length of the longest run of one word."""
    if not any(map(operator.eq, words, words[1:])):
        return min(1, len(words))
    best = now = 1
    for a, b in zip(words, words[1:]):
        now = now + 1 if a == b else 1
        best = max(best, now)
    return best


def features(text: str | None) -> np.ndarray:
    """Places of a text's features, each once."""
    if not text:
        return np.zeros(0, np.int64)
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = (b[:-1] << np.uint32(8) | b[1:]) + np.uint32(256)
    three = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) + np.uint32(256 + 65536)
    codes = np.concatenate([b, two, three])
    place = ((codes * np.uint32(2654435769)) >> np.uint32(15)).astype(np.int64)
    # The last of equal places keeps its seat, so each place is taken once without sorting.
    if not _seat:
        _seat.append(np.zeros(BUCKETS, np.int64))
    turn = np.arange(len(place))
    _seat[0][place] = turn
    once = place[_seat[0][place] == turn]
    run = longest_run(text.split())
    extra = [BUCKETS + i for i, n in enumerate(RUNS) if run >= n]
    return np.append(once, np.array(extra, np.int64)) if extra else once


class Model:
    """weights include the ratio of each feature; ratios give the row's length."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        self.ratio = np.zeros(FEATURES)
        self.weight = np.zeros(FEATURES)
        self.bias, self.slope, self.shift = 0.0, 0.0, 0.0
        n = [int((labels == c).sum()) for c in (0, 1)]
        if min(n) == 0:
            self.shift = 0.0 if sum(n) == 0 else 40.0 if n[1] else -40.0
            return
        seen = [np.full(FEATURES, SMOOTHING), np.full(FEATURES, SMOOTHING)]
        for row, label in zip(rows, labels):
            seen[label][row] += 1
        self.ratio = np.log((seen[1] / seen[1].sum()) / (seen[0] / seen[0].sum()))
        self._descend(rows, np.where(labels == 1, 1.0, -1.0), n)
        margins = np.array([self.margin(r) for r in rows])
        self._calibrate(margins, labels)

    def _descend(self, rows: list[np.ndarray], signs: np.ndarray, n: list[int]) -> None:
        """Dual coordinate descent: each row's multiplier lies between 0 and its class's cost."""
        values = [self.ratio[r] / max(1e-12, np.sqrt((self.ratio[r] ** 2).sum())) for r in rows]
        norms = np.array([(v**2).sum() + 1.0 for v in values])
        cost = np.where(signs > 0, COST * sum(n) / (2 * n[1]), COST * sum(n) / (2 * n[0]))
        w, b, dual = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
        shuffled = np.random.default_rng(7)
        for _ in range(EPOCHS):
            most = 0.0
            for i in shuffled.permutation(len(rows)):
                slack = signs[i] * (w[rows[i]] @ values[i] + b) - 1.0
                now = min(max(dual[i] - slack / norms[i], 0.0), cost[i])
                step = (now - dual[i]) * signs[i]
                if step:
                    w[rows[i]] += step * values[i]
                    b += step
                    most = max(most, abs(step))
                    dual[i] = now
            if most < 1e-3:
                break
        self.weight, self.bias = w * self.ratio, b

    def margin(self, row: np.ndarray) -> float:
        return self.weight[row].sum() / max(1e-12, np.sqrt((self.ratio[row] ** 2).sum())) + self.bias

    def _calibrate(self, margins: np.ndarray, labels: np.ndarray) -> None:
        """A logistic curve by Newton steps, towards targets just inside 0 and 1."""
        n1, n0 = (labels == 1).sum(), (labels == 0).sum()
        target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        x = np.stack([margins, np.ones(len(margins))], axis=1)
        beta = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0]))
            beta = beta - np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.shift = float(max(beta[0], 1e-6)), float(beta[1])

    def score(self, texts: list[str | None]) -> np.ndarray:
        margins = np.array([self.margin(features(t)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE) -> Model:
    """The model of labelled rows where `learnable` (a condition on doc_id) holds."""
    marked = labels.filter(learnable & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    marked = marked.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    picked = pin(drawn(marked, "quality", sample), "quality-sample")
    # At most 2 * sample ids are picked; an id may stand on many rows.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [features(t).astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("quality"), pa.array(places, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    made = rows.mapInArrow(run, "doc_id long, quality int, places binary")
    # Copies of one text count once, and are dropped before the driver sees them.
    table = made.groupBy("places", "quality").agg(F.min("doc_id").alias("doc_id")).collect()
    table.sort(key=lambda r: (r["doc_id"], bytes(r["places"])))
    unique = [(bytes(r["places"]), r["quality"]) for r in table]
    return Model([np.frombuffer(p, "<i4").astype(np.int64) for p, _ in unique], np.array([q for _, q in unique], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, learnable: Column) -> DataFrame:
    """The documents predicted good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, learnable))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(at).to_pylist()) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
