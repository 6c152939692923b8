"""Operator 6: exact n-gram Jaccard join in the metric space of Jaccard distance.

Documents with the same set are one class, which its smallest id stands for. A class whose shingles are
mostly its own is farther than the threshold t from everything and needs no region.

Of any pivots, nearly all documents are at distance 1, which no Voronoi split can tell apart. So the space
is first cut where distance 1 begins: each shingle among the first of a set (its prefix; frequent shingles
come last) names a pivot, the smallest document with that shingle in its prefix, and a document belongs to
the cells of the pivots that it names. Two sets that link share a prefix shingle, so they share a cell.

Each cell is joined as a metric space. Pivots drawn from it split it into Voronoi regions: a document goes
to its nearest pivot's by Jaccard distance, and it is replicated to each other pivot whose distance is
within 2t of that, for a partner nearest to that pivot can be no farther. Documents at 1 - t or more from
all pivots make a region of their own, as a partner of one that is nearer shares a shingle with its pivot.
Regions are split again by pivots of their own, recursively: cells of up to SMALL documents in one task,
larger ones by chunks over the cluster until they are small. What the windows do not separate is compared
by the triangle inequality on its distances from the pivots, in blocks where it is large. A pair in several
regions is compared in the first of them alone: members carry the earlier regions that they are in.

Only links that connect something are emitted; the number of links of each class is counted where its
pairs are compared. Texts without words, and null texts, have no shingles and are linked with nothing.
Rows that share an id count as one document, which has the links of all its texts; a null id is its own
component (null). Empty tables give empty results; other columns do not matter. Sets are compared by 64-bit
hashes.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import materialise, tenant
from lakeloom.llm.components import components
from lakeloom.llm.shingles import common, forget, prefix_length, shared, shingles

SAMPLE = 0.34  # share of the hash range that tells how much of a set is its own
ORDER_ROWS, ORDER_SIZE = 4096, 1 << 16  # sampled sets, and frequent shingles that the prefixes take last
SMALL = 512  # documents of a region that one task joins
CHUNK = 512  # documents of a chunk of a large region
PIVOTS = 16  # pivots of a large region
LEAF, SPLIT = 48, 8  # documents that a task compares without more pivots, and pivots of a split within it
LEVELS = 4  # splits of a large cell over the cluster
BROADCAST_ROWS = 500_000  # of numbers, that a join may broadcast
DENSE = 3  # a split that makes so many times the rows separates nothing


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def features(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """doc, n, set (fingerprint), cls (its first 64 bits) and low (hashes below SAMPLE of the range)."""
    top = np.uint64(int(SAMPLE * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant("shingles", forget)
        for b in batches:
            sets = [shingles(t, width) for t in b.column(1).to_pylist()]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            cls = [int.from_bytes(p[:8], "little", signed=True) for p in prints]
            low = [s[: np.searchsorted(s, top)].view(np.int64) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, low)]), pa.int32()), pa.array(np.concatenate(low) if low else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(cls, pa.int64()), lists], ["doc", "n", "set", "cls", "low"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc long, n long, set binary, cls long, low array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first columns."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _by_group(df: DataFrame, keys: list[str], order: list[str], run: Callable, schema: str) -> DataFrame:
    """Runs over rows that are grouped by ``keys`` within partitions."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _linked(inter: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (n + sizes - inter)


def distances(pivot: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard distances of sets from a pivot."""
    inter = common(pivot, sets)
    return 1 - inter / np.maximum(1, np.array([len(s) for s in sets]) + len(pivot) - inter)


def nearby(far: np.ndarray, room: float) -> tuple[list[np.ndarray], np.ndarray]:
    """From distances (pivots by documents): the members of each pivot's region, and the documents that
    are too far from all pivots. Members are those nearest to the pivot and those in its window."""
    least, own = far.min(axis=0), far.argmin(axis=0)
    out = least >= 1 - room - 1e-9
    regions = []
    for k in range(len(far)):
        core = (own == k) & ~out
        regions.append(core | ((far[k] <= least + 2 * room + 1e-9) & (far[k] < 1)) if core.any() else core)
    return regions, out


class Region:
    """Joins the sets of one region in memory. ``before`` are the earlier regions that each set is in."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], before: list[list[int]], percent: int, every: bool):
        self.ids, self.sets, self.percent, self.every = ids, sets, percent, every
        self.sizes, self.label = np.array([len(s) for s in sets], np.int64), np.arange(len(ids))
        self.counts, self.links = np.zeros(len(ids), np.int64), []
        self.room = 1 - percent / 100
        keys, place = np.unique([k for b in before for k in b], return_inverse=True) if any(before) else (np.zeros(0), np.zeros(0, int))
        self.before = np.zeros((len(ids), len(keys)), np.float32)
        self.before[np.repeat(np.arange(len(ids)), [len(b) for b in before]), place] = 1

    def join(self) -> None:
        self._split(np.arange(len(self.ids)), self.before, 6)

    def _split(self, own: np.ndarray, before: np.ndarray, depth: int) -> None:
        if len(own) <= LEAF or not depth:
            return self._compare(own, before, None)
        sets = [self.sets[i] for i in own]
        far = np.stack([distances(self.sets[p], sets) for p in own[:: max(1, len(own) // SPLIT)][:SPLIT]])
        regions, out = nearby(far, self.room)
        regions = [r for r in [*regions, out] if r.any()]
        if sum(int(r.sum()) for r in regions) > 2 * len(own) or any(r.all() for r in regions):
            return self._compare(own, before, far)
        for k, r in enumerate(regions):
            self._split(own[r], np.column_stack([before[r], *(e[r] for e in regions[:k])]), depth - 1)

    def _compare(self, own: np.ndarray, before: np.ndarray, far: np.ndarray | None, first: int | None = None) -> None:
        """Pairs of ``own``; of the first ``first`` with the others, where that is given."""
        sizes, later = self.sizes[own], np.arange(len(own))
        for k in range(len(own) - 1 if first is None else first):
            p = own[k]
            fit = (later > k if first is None else later >= first) & (100 * np.minimum(sizes, sizes[k]) >= self.percent * np.maximum(sizes, sizes[k]))
            if not self.every:
                fit &= self.label[own] != self.label[p]
            if far is not None:
                fit &= (np.abs(far - far[:, k : k + 1]) <= self.room + 1e-9).all(axis=0)
            near = np.flatnonzero(fit)
            if len(near) and before.shape[1]:
                near = near[before[near] @ before[k] == 0]
            if not len(near):
                continue
            found = own[near][_linked(common(self.sets[p], [self.sets[i] for i in own[near]]), int(sizes[k]), sizes[near], self.percent)]
            self.counts[found] += 1
            self.counts[p] += len(found)
            for i in found:
                if self.label[i] != self.label[p]:
                    self.links.append((self.ids[p], self.ids[i]))
                    self.label[self.label == self.label[i]] = self.label[p]

    def rows(self) -> pa.RecordBatch:
        """Links (a, b) and, where all are wanted, numbers of links (a, n)."""
        own = [(i, None, int(c)) for i, c in zip(self.ids, self.counts) if c and self.every]
        return _rows([(a, b, None) for a, b in self.links] + own)


FOUND = "a long, b long, n long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(3)], ["a", "b", "n"])


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return _rows([(a, b, None) for a, b in links])


def _join_small(members: DataFrame, percent: int, every: bool) -> DataFrame:
    """Links within small regions: members (region, doc, before, full)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 1):
            region = Region([r[0] for r in rows], [_array(r[2]) for r in rows], [r[1] for r in rows], percent, every)
            region.join()
            if region.links or region.counts.any():
                yield region.rows()

    return _by_group(members.select("region", "doc", "before", "full"), ["region"], ["doc"], run, FOUND)


def _join_blocks(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """All links within large regions, by pairs of chunks: members (region, doc, before, full)."""
    chunks = F.ceil(F.col("size") / CHUNK)
    dealt = members.join(sizes, "region").withColumn("chunk", F.pmod(F.xxhash64("doc", F.lit(1)), chunks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other")
    met = dealt.select("region", "chunk", "doc", "before", "full", other)
    met = met.select("region", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "doc", "before", "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _groups(batches, 3):
            region = Region([r[1] for r in rows], [_array(r[3]) for r in rows], [r[2] for r in rows], percent, True)
            first = None if i == j else sum(r[0] == i for r in rows)
            region._compare(np.arange(len(rows)), region.before, None, first)
            if region.links:
                yield region.rows()

    return _by_group(met, ["region", "i", "j"], ["chunk", "doc"], run, FOUND)


def _join_dense(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links within large regions of documents that are near each other: members (region, doc, full)."""
    members = members.join(sizes, "region").withColumn("chunk", F.pmod(F.xxhash64("doc", F.lit(1)), F.ceil(F.col("size") / CHUNK)))
    members = materialise(members.select("region", "doc", "full", "chunk", "size"), "dense")
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / CHUNK) - 1))

    def meet(batches: Iterator[pa.RecordBatch], brief: bool) -> Iterator[pa.RecordBatch]:
        """Links of a block's pivots (role 1) with its members (role 0, or 2 in the main component)."""
        for _, rows in _groups(batches, 3):
            own = [r for r in rows if r[0] != 1]
            ids, sets, main = [r[1] for r in own], [_array(r[2]) for r in own], np.array([r[0] == 2 for r in own])
            size, links = np.array([len(s) for s in sets]), []
            for _, doc, full in (r for r in rows if r[0] == 1):
                p = _array(full)
                found = np.flatnonzero(_linked(common(p, sets), len(p), size, percent)) if sets else []
                if brief and len(found):
                    inside = [i for i in found if main[i]]
                    found = [i for i in found if not main[i]] + inside[:1]
                links += [(doc, ids[i]) for i in found if ids[i] != doc]
            if links:
                yield _pairs(links)

    spread = F.pmod(F.xxhash64("doc", F.lit(2)), F.lit(1 << 30)) / (1 << 30)
    pivots = members.where(spread < F.lit(PIVOTS) / F.col("size"))
    zero = F.lit(0).cast("long")
    stars = members.select("region", "chunk", zero.alias("block"), F.lit(0).alias("role"), "doc", "full").union(pivots.select("region", chunks.alias("chunk"), zero, F.lit(1), "doc", "full"))
    first = materialise(_by_group(stars, ["region", "chunk", "block"], ["role", "doc"], lambda b: meet(b, False), FOUND), "stars")
    label = components(first)
    tagged = members.select("region", "doc", "chunk", "size").join(label.withColumnRenamed("node", "doc"), "doc", "left")
    main = tagged.where("component IS NOT NULL").groupBy("region", "component").count().groupBy("region").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    tagged = tagged.join(main, "region", "left").select("region", "doc", F.coalesce(F.col("component") == F.col("main"), F.lit(False)).alias("inside"))
    tagged = materialise(members.join(tagged, ["region", "doc"]), "tagged")
    outside = tagged.where("NOT inside")
    blocks = outside.groupBy("region").agg(F.ceil(F.count("*") / CHUNK).alias("blocks"))
    rest = outside.join(blocks, "region").select("region", chunks.alias("chunk"), F.pmod(F.xxhash64("doc", F.lit(3)), "blocks").alias("block"), F.lit(1).alias("role"), "doc", "full")
    every = tagged.join(blocks, "region").select("region", "chunk", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), F.when(F.col("inside"), 2).otherwise(0).alias("role"), "doc", "full")
    second = _by_group(every.union(rest), ["region", "chunk", "block"], ["role", "doc"], lambda b: meet(b, True), FOUND)
    return first.union(materialise(second, "rest"))


BITS = 1 << 23  # of the map that tells early which documents need no set; its size does not grow


def _bitmap(survivors: DataFrame) -> bytes:
    """One bit for the hash of each survivor's id."""
    spot = survivors.select(F.pmod(F.xxhash64("doc"), F.lit(BITS)).alias("p"))
    words = spot.groupBy(F.floor(F.col("p") / 32).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 32).cast("int"))).alias("bits"))
    out = np.zeros(BITS // 32, "<u4")
    for r in words.toLocalIterator():
        out[r["w"]] = r["bits"]
    return out.tobytes()


def _sets(docs: DataFrame, survivors: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc, full, n) of the survivors."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(survivors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        for b in batches:
            b = b.filter(pa.array(marked[b.column(2).to_numpy()]))
            found = [shingles(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64())], ["doc", "full", "n"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("t")).where("doc IS NOT NULL")
    rows = rows.withColumn("p", F.pmod(F.xxhash64("doc"), F.lit(BITS)))
    return rows.mapInArrow(run, "doc long, full binary, n long").join(survivors, "doc", "left_semi")


def frequent(sets: DataFrame, n: int) -> np.ndarray:
    """The most frequent shingles of a bounded sample of sets, most frequent last. They decide which of a
    set's shingles are its prefix, so how large cells get; results do not depend on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_array(x).view(np.int64).tolist() for x in b.column(0).to_pylist()], pa.list_(pa.int64()))], ["hs"])

    part = sets.where(F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(1 << 30)) / (1 << 30) < F.lit(ORDER_ROWS / max(1, n)))
    counts = part.select("full").mapInArrow(run, "hs array<long>").select(F.explode("hs").alias("h")).groupBy("h").count()
    rows = counts.where("count >= 3").orderBy(F.desc("count"), "h").limit(ORDER_SIZE).collect()
    return np.array([r["h"] for r in reversed(rows)], np.int64).view(np.uint64)


def prefix(own: np.ndarray, late: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """A set's first elements in the order of hashes, frequent ones last: ``late`` is sorted, ``place``
    tells where each of it comes."""
    spot = np.minimum(np.searchsorted(late, own), max(len(late) - 1, 0))
    last = late[spot] == own if len(late) else np.zeros(len(own), bool)
    k = prefix_length(len(own), percent)
    first = own[~last][:k]
    if len(first) == k:
        return first
    rest = own[last]
    return np.concatenate([first, rest[np.argsort(place[spot[last]])][: k - len(first)]])


def cells(sets: DataFrame, n: int, percent: int) -> DataFrame:
    """(region, doc, before): the cells of the pivots that each document's prefix names, and those of them
    that come before each."""
    order = frequent(sets, n)
    spot = np.argsort(order)
    shared_order = sets.sparkSession.sparkContext.broadcast((order[spot], spot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, place = shared_order.value
        for b in batches:
            keys = [prefix(_array(x), late, place, percent).view(np.int64).tolist() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], ["doc", "keys"])

    keys = sets.select("doc", "full").mapInArrow(run, "doc long, keys array<long>").select("doc", F.explode("keys").alias("h"))
    # the keys meet by shingle once, for its least document and for those that share it
    held = Window.partitionBy("h")
    named = keys.withColumn("owner", F.min("doc").over(held)).withColumn("last", F.max("doc").over(held)).where("last > owner")
    pairs = named.select("doc", F.col("owner").alias("region")).distinct()
    own = _sized(materialise(pairs, "pairs"), sets, percent).groupBy("doc").agg(F.array_sort(F.collect_set("region")).alias("owners"))
    every = own.select("doc", "owners", F.posexplode("owners").alias("k", "region"))
    every = materialise(every.select("region", "doc", F.slice("owners", 1, F.col("k")).alias("before")), "cells")
    # a cell whose documents are all in one earlier cell has no pair that is not met there
    within = every.select("region", F.explode("before").alias("earlier")).groupBy("region", "earlier").count()
    sizes = every.groupBy("region").agg(F.count("*").alias("count"))
    again = within.join(sizes, ["region", "count"], "left_semi").select("region").distinct()
    return materialise(every.join(again, "region", "left_anti"), "regions")


def _sized(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (region, doc) but those that no other member's size comes near: sizes of sets that link lie in
    the same band or in neighbouring ones, each as wide as the sizes of such sets can differ. So a text that
    is put together from thousands of short ones is in none of their cells."""
    band = F.floor(F.log("n") / math.log(100 / percent) + 1e-9)
    rows = members.join(sets.select("doc", "n"), "doc").withColumn("band", band)
    order = Window.partitionBy("region").orderBy("band")  # a row a band, which are few
    gap = lambda f: F.coalesce(F.abs(f("band", 1).over(order) - F.col("band")), F.lit(9)) <= 1
    counts = rows.groupBy("region", "band").agg(F.count("*").alias("same"))
    counts = counts.select("region", "band", "same", gap(F.lag).alias("below"), gap(F.lead).alias("above"))
    return rows.join(counts.where("same > 1 OR below OR above"), ["region", "band"], "left_semi").select("region", "doc")


def _known(ids: DataFrame, width: int = 1) -> DataFrame:
    """Rows of a written table of ids, broadcast where they are counted to be few."""
    return F.broadcast(ids) if ids.count() * width <= BROADCAST_ROWS else ids


def _split(members: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, level: int) -> DataFrame:
    """(parent, region, doc, before): the Voronoi regions that pivots of each large region make of it."""
    room = 1 - percent / 100
    deal = members.join(sizes, "region").withColumn("chunks", F.ceil(F.col("size") / (8 * CHUNK)))
    deal = _known(materialise(deal, "deal"))
    drawn = F.pmod(F.xxhash64("doc", F.lit(10 + level)), F.lit(1 << 30)) / (1 << 30) < F.lit(PIVOTS) / F.col("size")
    rows = sets.select("doc", "full").join(deal, "doc")
    pivots = rows.where(drawn).select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), "doc", F.array().cast("array<long>").alias("before"), "full")
    rows = rows.select("region", F.pmod(F.xxhash64("doc", F.lit(1)), "chunks").alias("chunk"), F.lit(1).alias("role"), "doc", "before", "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (region, _), own in _groups(batches, 2):
            pivot = [(r[1], _array(r[3])) for r in own if r[0] == 0]
            own = [r for r in own if r[0] == 1]
            key = [struct.unpack("<q", xxhash.xxh64_digest(struct.pack("<qq", region, p)))[0] for p, _ in pivot] + [struct.unpack("<q", xxhash.xxh64_digest(struct.pack("<q", region)))[0]]
            sets = [_array(r[3]) for r in own]
            inside, out = nearby(np.stack([distances(p, sets) for _, p in pivot]), room) if pivot and own else ([], np.ones(len(own), bool))
            place = sorted(range(len(key)), key=lambda k: key[k])
            made: tuple[list, list, list] = ([], [], [])
            for i, r in enumerate(own):
                mine = [key[k] for k in place if (out[i] if k == len(key) - 1 else inside[k][i])]
                for k, child in enumerate(mine):
                    for column, value in zip(made, (child, r[1], r[2] + mine[:k])):
                        column.append(value)
            if made[0]:
                yield pa.RecordBatch.from_arrays([pa.array([region] * len(made[0]), pa.int64()), pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.list_(pa.int64()))], ["parent", "region", "doc", "before"])

    return _by_group(pivots.union(rows), ["region", "chunk"], ["role", "doc"], run, "parent long, region long, doc long, before array<long>")


def links(docs: DataFrame, survivors: DataFrame, doc_id: str, text: str, width: int, percent: int, every: bool) -> DataFrame:
    """Links (a, b) that connect the documents whose ids are in survivors (doc) as all links do, and with
    ``every`` rows (a, n) that sum up to the number of links of a."""
    sets = materialise(_sets(docs, survivors, doc_id, text, width), "sets")
    members, small, dense = cells(sets, sets.count(), percent), [], []
    for level in range(LEVELS + 1):
        sizes = materialise(members.groupBy("region").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        small.append(members.join(sizes.where(F.col("size") <= SMALL), "region", "left_semi"))
        large = sizes.where(F.col("size") > SMALL)
        if not large.limit(1).count():
            break
        members = members.join(large, "region", "left_semi")
        if level == LEVELS:
            dense.append((members, large))
            break
        parts = materialise(_split(members, large, sets, percent, level), "regions")
        grown = parts.groupBy("parent").agg(F.count("*").alias("made")).withColumnRenamed("parent", "region")
        hard = materialise(large.join(grown, "region").where(F.col("made") > DENSE * F.col("size")).select("region", "size"), "hard")
        dense.append((members.join(hard, "region", "left_semi"), hard))
        members = parts.join(hard.select(F.col("region").alias("parent")), "parent", "left_anti").select("region", "doc", "before")
    full = sets.select("doc", "full")
    out = _join_small(full.join(_known(materialise(reduce(DataFrame.union, small), "small"), 4), "doc"), percent, every)
    if dense:
        members, sizes = (reduce(DataFrame.union, x) for x in zip(*dense))
        sizes = materialise(sizes, "sizes")
        if sizes.limit(1).count():
            rows = full.join(_known(materialise(members, "dense")), "doc")
            out = out.union(_join_blocks(rows, sizes, percent) if every else _join_dense(rows.drop("before"), sizes, percent))
    return materialise(out, "links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set) and component_id of each row; with
    ``count_links`` also n_links, how many other classes the row's class links with."""
    own = materialise(features(docs, doc_id, text, width), "features")
    classes = materialise(own.where("n > 0 AND doc IS NOT NULL").groupBy("set").agg(F.min("doc").alias("rep"), F.first("cls").alias("cls"), F.first("n").alias("n")), "classes")
    spread = own.where("doc IS NOT NULL").select(F.explode("low").alias("h"), "cls").groupBy("h").agg(F.min("cls").alias("cls"), F.max("cls").alias("other"))
    alone = spread.where("cls = other").groupBy("cls").agg(F.count("*").alias("alone"))
    most = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100)
    survivors = classes.join(alone, "cls", "left").where(F.coalesce("alone", F.lit(0)) <= most).select(F.col("rep").alias("doc"))
    found = links(docs, materialise(survivors, "survivors"), doc_id, text, width, percent, count_links)
    label = components(found.where("b IS NOT NULL"))
    reps = classes.select("set", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("set", "rep", F.coalesce("component", "rep").alias("component"))
    if count_links:
        reps = reps.join(found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links")), "rep", "left")
    rows = own.select("doc", "n", F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("set")).alias("set"))
    out = [F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("rep", "doc").alias("class_id"), F.coalesce("component", "doc").alias("component_id")]
    return rows.join(reps, "set", "left").select(*out, *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []))
