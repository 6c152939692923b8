"""Operator 10: best-fit decreasing packing of tokenised documents into sequences.

Documents are encoded, closed with an end id and cut into pieces only where they are longer than a
sequence. Best-fit decreasing needs nothing of the pieces but how many there are of each length, so it
runs over that histogram, which has at most ``capacity`` entries however large the corpus is. A segment
tree over remaining capacities finds the tightest open bin in logarithmic time; equal pieces that would
go to equal bins are placed together, exactly as one after the other. The plan says which bins and offsets
the r-th piece of a length gets; executors look up their pieces in it. The rank of a piece among those of
its length comes from counts by partition and length, so no task gathers the pieces of a length.

Null text counts as empty: the document is its end id alone. Repeated rows are packed each, under whatever
id; a text of any length is cut, never dropped. Empty tables
give empty results; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import materialise
from lakeloom.llm.spans import gathered, worker_encoder


BROADCAST_ROWS = 500_000


class Capacities:
    """Segment tree over remaining capacities: how many open bins have each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, c: int, n: int) -> None:
        k = self.size + c
        while k:
            self.tree[k] += n
            k >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open bin has."""
        k = self.size + least
        if self.tree[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.tree[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.tree[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, pieces a bin, first bin, offset) of best-fit decreasing.

    The r-th piece of a run goes to bin first + r // a_bin, at offset + (r % a_bin) * length.
    """
    tree, open_bins, runs, bins = Capacities(capacity), {}, [], 0
    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            c = tree.tightest(length)
            if c is None:
                c, first, there = capacity, bins, -(-left // (capacity // length))
                bins += there
            else:
                first, there = open_bins[c].pop()
                tree.add(c, -there)
            each = c // length
            used, per = (min(there, left // each), each) if left >= each else (1, left)
            runs.append((length, rank, used * per, per, first, capacity - c))
            rank, left = rank + used * per, left - used * per
            for at, n, room in ((first, used, c - per * length), (first + used, there - used, c)):
                if n and room and not (room == capacity):
                    open_bins.setdefault(room, []).append((at, n))
                    tree.add(room, n)
                elif n and room:
                    bins = at  # bins that were not needed yet
    return runs


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text", room: int = 250_000, chars: int = 4_000_000) -> DataFrame:
    """The documents' pieces, with the partition and the rank in it among pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = worker_encoder(path, "ids", room), Counter(), TaskContext.get().partitionId()
        end, step = end_id.to_bytes(4, "little"), 4 * capacity
        for b in gathered(batches, 1, chars):
            rows, texts = [], [t or "" for t in b.column(1).to_pylist()]
            for first, counts, flat in encoder.batches(texts, chars):
                ends = np.cumsum(counts).tolist()
                for i, (begin, stop) in enumerate(zip([0, *ends], ends), first):
                    ids = flat[begin:stop].tobytes() + end
                    for k, at in enumerate(range(0, len(ids), step)):
                        piece = ids[at : at + step]
                        n = len(piece) // 4
                        rows.append((i, k, at // 4, n, zlib.crc32(piece), part, seen[n]))
                        seen[n] += 1
            cols = list(zip(*rows)) or [()] * 7
            arrays = [b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", room: int = 250_000, chars: int = 4_000_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece.

    A worker keeps the ids of about ``room`` spans and looks at ``chars`` characters at once: more of either
    takes memory and saves time.
    """
    cut = materialise(pieces(docs, path, capacity, end_id, doc_id, text, room, chars), "pieces")
    counts = materialise(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit(lengths, capacity)
    by_length: dict[int, list] = {}
    for r in runs:
        by_length.setdefault(r[0], []).append(r[1:])
    table = {k: np.array(v, np.int64) for k, v in by_length.items()}
    shared = docs.sparkSession.sparkContext.broadcast(table)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    # a row for each length in each partition: broadcast only where these are counted to be few
    first = F.broadcast(first) if counts.count() <= BROADCAST_ROWS else first.hint("merge")
    ranked = cut.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                r = plan[k][np.searchsorted(plan[k][:, 0], rank[own], "right") - 1]
                nth = rank[own] - r[:, 0]
                sequence[own] = r[:, 3] + nth // r[:, 2]
                offset[own] = r[:, 4] + nth % r[:, 2] * k
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
