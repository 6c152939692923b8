"""Operator 8: language identification by nearest centroid.

A text is a normalised TF-IDF vector of its hashed character n-grams (orders 1 to 3). Each language has
several centroids, found by spherical k-means over its training texts. The prediction is the language of
the centroid with the largest cosine. A text whose distance from that centroid exceeds what its
language's training texts of like length show is rejected: each half of them is held against centroids of
the other half, and what lies clearly below nearly all of these cosines is out. Lengths with few training
texts take the most lenient of the language's floors, which falls for texts shorter than those known.

The centroids are fitted on at most ``per_language`` texts of a language, of at most ``max_chars``
characters each; every text is scored whole. Null texts and texts without a letter get ``und``, score 0
and are rejected; so does every text where nothing can be learned. Equal cosines go to the language that
comes first in text order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import ngrams
from lakeloom.llm.common import learnable, tenant

DIMS = 4096
ORDERS = range(1, 4)
BANDS = 32
SLACK = 0.8  # a text may fall this much short of what left-out texts show


@dataclass
class Centroids:
    languages: list[str]
    owner: np.ndarray  # of each centroid, the place of its language
    vectors: np.ndarray  # centroids by dimensions, normalised
    idf: np.ndarray
    floor: np.ndarray  # languages by bands of length: the least cosine that is not rejected
    sharpness: float = 24.0

    def scored(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: the language's place (-1: und), the score, the cosine and its floor."""
        best, score, cosine, least = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        for at in range(0, len(texts), 256):
            block = [counts(t) for t in texts[at : at + 256]]
            rows = [i for i, c in enumerate(block) if c is not None]
            if not rows or not self.languages:
                continue
            found = np.stack([block[i] for i in rows])
            cos = weighted(found, self.idf) @ self.vectors.T
            by = np.stack([cos[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1).astype(float)
            pick = by.argmax(axis=1)
            top = by[np.arange(len(rows)), pick]
            share = 1 / np.exp(self.sharpness * (by - top[:, None])).sum(axis=1)
            where = np.array(rows) + at
            best[where], score[where], cosine[where], least[where] = pick, share, top, self.floor[pick, bands(found)]
        return best, score, cosine, least


def counts(text: str | None) -> np.ndarray | None:
    """How often the text has the n-grams of each bucket; None without a letter."""
    points = ngrams.codes(text or "")
    if len(points) < 2:
        return None
    buckets = np.concatenate(ngrams.hashes(points, ORDERS)) & np.uint64(DIMS - 1)
    return np.bincount(buckets.astype(np.int64), minlength=DIMS).astype(np.float32)


def bands(rows: np.ndarray) -> np.ndarray:
    """The band of length of each text's counts: powers of two of its n-grams."""
    return np.minimum(np.log2(np.maximum(rows.sum(axis=1), 1)).astype(int), BANDS - 1)


def floors(rows: np.ndarray, band: np.ndarray, clusters: int) -> np.ndarray:
    """For each band the least cosine that a text of the language is expected to have."""
    half = np.arange(len(rows)) % 2 == 0
    cosine = np.zeros(len(rows))
    for own in (half, ~half) if len(rows) > 1 else ():
        cosine[own] = (rows[own] @ clustered(rows[~own], clusters).T).max(axis=1)
    lowest = lambda c: min(np.quantile(c, 0.001), c.mean() - 4 * c.std())
    many = {b: lowest(cosine[band == b]) for b in np.unique(band) if (band == b).sum() >= 30}
    out = np.full(BANDS, min(many.values()) if many else lowest(cosine))
    for b, c in many.items():
        out[b] = c
    # Below the shortest length that is known, cosines fall with the length.
    first = min(many) if many else int(band.min())
    return SLACK * out * 2.0 ** (np.minimum(np.arange(BANDS) - first, 0) / 4)


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(rows) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def clustered(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows far from those already chosen."""
    centres = [rows[0]]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[np.argmin((rows @ np.stack(centres).T).max(axis=1))])
    found = np.stack(centres)
    for _ in range(rounds):
        own = (rows @ found.T).argmax(axis=1)
        for c in range(len(found)):
            if (own == c).any():
                found[c] = rows[own == c].mean(axis=0)
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return found


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", clusters: int = 4, per_language: int = 1000, max_chars: int = 20_000) -> Centroids:
    """Learns from rows with text and language that are not held out."""
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & learnable("i") & (F.length("t") <= max_chars))
    nothing = Centroids([], np.zeros(0, int), np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), np.zeros((0, BANDS)))
    share = {r["l"]: min(1.0, per_language / r["n"]) for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not share:
        return nothing
    spread = F.pmod(F.xxhash64("i"), F.lit(1_000_000)) / 1_000_000
    wanted = F.element_at(F.create_map(*(F.lit(x) for kv in sorted(share.items()) for x in kv)), F.col("l"))
    learned: dict[str, list[np.ndarray]] = {}
    for r in rows.where(spread < wanted).orderBy("i").toLocalIterator():
        if (c := counts(r["t"])) is not None:
            learned.setdefault(r["l"], []).append(c)
    names = sorted(learned)
    if not names:
        return nothing
    df = sum((np.stack(learned[x]) > 0).sum(axis=0) for x in names)
    n = sum(map(len, learned.values()))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    vectors, owner, floor = [], [], []
    for k, x in enumerate(names):
        raw = np.stack(learned.pop(x))
        own = weighted(raw, idf)
        found = clustered(own, clusters)
        vectors.append(found)
        owner += [k] * len(found)
        floor.append(floors(own, bands(raw), clusters))
    return Centroids(names, np.array(owner), np.concatenate(vectors), idf, np.array(floor))


def identify(docs: DataFrame, model: Centroids, keep: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``keep`` of each row, and lang_pred, score, cosine and rejected.

    Columns of ``keep`` with the names of new columns give way to these.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ["lang_pred", "score", "cosine", "rejected"]
    kept = [c for c in keep if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant("language_id")
        m = shared.value
        for b in batches:
            best, score, cosine, least = m.scored(b.column(len(kept)).to_pylist())
            names = pa.array([m.languages[k] if k >= 0 else "und" for k in best], pa.string())
            rejected = pa.array((best < 0) | (cosine < least), pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), names, pa.array(score), pa.array(cosine), rejected], [*kept, *new])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    rows = docs.select(*kept, F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"{schema}lang_pred string, score double, cosine double, rejected boolean")
