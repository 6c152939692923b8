"""Operator 2: toxicity by a linear classifier over character n-grams.

Features are the presence of character n-grams (orders 3 to 6, over letters and word ends), scaled by
their naive Bayes log-count ratios; a logistic regression over the scaled features gives the score.
It is fitted on at most about ``toxic_rows`` and ``clean_rows`` labelled texts of at most ``max_chars``
characters, and keeps the ``features`` n-grams that tell their classes apart best, of those that occur in
``least`` of them: bounds of the model, whatever the corpus. Every text is scored whole.

Null and empty texts have no features and get the score of the intercept. Labels that contradict each
other for a document count as toxic; null labels do not count. Where one class is missing, nothing can
be learned and every score is 0. Every row of ``docs`` gets a score, repeated ids included.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import ngrams
from lakeloom.llm.common import held_out, learnable, tenant

ORDERS = range(3, 7)
_SIEVE = 1 << 20


def grams(text: str | None) -> np.ndarray:
    """Hashes of all n-grams of the text, with repeats."""
    return np.concatenate(ngrams.hashes(ngrams.codes(text or ""), ORDERS))


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # log-count ratio times coefficient
    intercept: float

    def sieve(self) -> np.ndarray:
        out = np.zeros(_SIEVE, bool)
        out[(self.features & np.uint64(_SIEVE - 1)).astype(np.int64)] = True
        return out

    def places(self, text: str | None, sieve: np.ndarray) -> np.ndarray:
        """The features that the text has."""
        g = grams(text)
        g = g[sieve[(g & np.uint64(_SIEVE - 1)).astype(np.int64)]]
        if not len(g) or not len(self.features):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, g), len(self.features) - 1)
        return np.unique(at[self.features[at] == g])

    def score(self, text: str | None, sieve: np.ndarray) -> float:
        if self.intercept == -np.inf:
            return 0.0
        z = self.intercept + self.weights[self.places(text, sieve)].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def logistic(rows: list[np.ndarray], x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Coefficients and intercept: full-batch accelerated gradient over sparse rows.

    ``rows`` holds the features of each text, ``x`` the value that a feature has where it is present.
    """
    n, m = len(rows), len(x)
    cols = np.concatenate(rows) if n else np.zeros(0, np.int64)
    line = np.repeat(np.arange(n), [len(r) for r in rows])
    values = x[cols]
    w, b = np.zeros(m), 0.0
    m1, m2, b1, b2 = np.zeros(m), np.zeros(m), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(line, w[cols] * values, n) + b, -500, 500)))
        g = np.bincount(cols, (p - y)[line] * values, m) / n + l2 * w
        gb = (p - y).mean()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        rate = 0.05 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= rate * m1 / (np.sqrt(m2) + 1e-8)
        b -= rate * b1 / (np.sqrt(b2) + 1e-8)
    return w, b


def train(texts: list[str], toxic: list[int], features: int = 8192, least: int = 3, l2: float = 1e-4) -> Model:
    """Chooses the features that tell the classes apart best, then fits their coefficients."""
    y = np.array(toxic, float)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    wide = 1 << 22
    seen = np.zeros((2, wide), np.int32)
    for t, k in zip(texts, toxic):
        seen[k, np.unique((grams(t) & np.uint64(wide - 1)).astype(np.int64))] += 1
    gain = np.abs(ratio(seen[1], seen[0], n1, n0)) * np.sqrt(seen[0] * (n1 / n0) + seen[1])
    gain[seen.sum(axis=0) < least] = 0
    cut = max(np.partition(gain, -features)[-features], 1e-9)
    good = gain >= cut
    count: tuple[Counter, Counter] = (Counter(), Counter())
    for t, k in zip(texts, toxic):
        g = grams(t)
        count[k].update(np.unique(g[good[(g & np.uint64(wide - 1)).astype(np.int64)]]).tolist())
    keys = np.array(sorted(h for h in {*count[0], *count[1]} if count[0][h] + count[1][h] >= least), np.uint64)
    r = ratio(*(np.array([count[k][h] for h in keys.tolist()], float) for k in (1, 0)), n1, n0)
    model = Model(keys, r, 0.0)
    sieve = model.sieve()
    w, b = logistic([model.places(t, sieve) for t in texts], r, y, l2)
    return Model(keys, w * r, b)


def ratio(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int, alpha: float = 0.5) -> np.ndarray:
    """Naive Bayes log-count ratio of features by the number of texts of each class that have them."""
    return np.log((toxic + alpha) / (n1 + 2 * alpha)) - np.log((clean + alpha) / (n0 + 2 * alpha))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", toxic_rows: int = 3000, clean_rows: int = 5000, max_chars: int = 12_000) -> Model:
    """Learns from labelled rows that are not held out."""
    marks = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i IS NOT NULL AND y IN (0, 1)")
    marks = marks.where(learnable("i")).groupBy("i").agg(F.max("y").alias("y"))
    have = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, toxic_rows / max(1, have.get(1, 1))).otherwise(clean_rows / max(1, have.get(0, 1)))
    chosen = marks.where(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) / 1_000_000 < share)
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).cast("string").alias("t")).where(F.length("t") <= max_chars)
    rows = rows.join(F.broadcast(chosen), "i")  # about toxic_rows + clean_rows pairs of numbers, whatever the labels' size
    texts, toxic = [], []
    for r in rows.orderBy("i", "t").toLocalIterator():
        texts.append(r["t"])
        toxic.append(r["y"])
    return train(texts, toxic)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 where score >= 0.5) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant("toxicity")
        m = shared.value
        sieve = m.sieve()
        for b in batches:
            found = [m.score(t, sieve) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64()), pa.array([int(x >= 0.5) for x in found], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
