"""Operator 5, the tables around its blocks: documents to token files and back.

``write`` encodes documents with the tokenizers library, closes each with an end id, deals them by ranges
of ids to files, in ascending order of ids, and writes each file as blocks of ``block_ids`` ids, of which
only a file's last has fewer. ``read`` decodes the blocks, each on its own in whatever task, checks them and
gives each document's place. A document may span blocks; the checksum of its ids then follows from those of
its pieces. What a task holds is a batch of texts and a block.

Null text counts as empty: the end id alone. Documents keep their order by id, null ids first, and rows
that share an id the order of their texts; each row is a document. Empty tables give no blocks and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm import token_blocks as blocks
from lakeloom.llm.spans import gathered, worker_joiner

PIECE = pa.struct([("doc_id", pa.int64()), ("ordinal", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
_RAW = "part int, block int, start long, n int, documents array<struct<doc_id: bigint, ordinal: bigint, at: int, n: int>>, raw binary"
FILES = _RAW.replace("raw binary", "data binary")


def write(docs: DataFrame, path: str, folder: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", block_ids: int = 16_384, room: int = 300_000) -> None:
    """Writes rows (part, block, start, n, documents, data): data is a framed block of the n ids that follow
    the file's first ``start``, documents the pieces in it: the document's id, its ordinal in the file, its place in the block and its ids there."""
    if not 0 < block_ids <= blocks.MOST:
        raise ValueError(f"a block has 1 to {blocks.MOST} ids")
    blocks.install(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, end = worker_joiner(path, room), TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        whole, block, start, ordinal, data, pieces = 4 * block_ids, 0, 0, 0, bytearray(), []

        def row(size: int) -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([size // 4], pa.int32()), pa.array([pieces], pa.list_(PIECE)), pa.array([bytes(data[:size])], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "block", "start", "n", "documents", "raw"])

        for b in gathered(batches, 1, 8_000_000):
            names = b.column(0).to_pylist()
            for first, counts, flat in encoder.texts(b.column(1)):
                ends = np.cumsum(counts).tolist()
                for i, begin, stop in zip(names[first:], [0, *ends], ends):
                    ids = flat[begin:stop].tobytes() + end
                    at = 0
                    while at < len(ids):
                        size = min(whole - len(data), len(ids) - at)
                        pieces.append({"doc_id": i, "ordinal": ordinal, "at": len(data) // 4, "n": size // 4})
                        data += ids[at : at + size]
                        at += size
                        if len(data) == whole:
                            yield row(whole)
                            block, start, data, pieces = block + 1, start + block_ids, bytearray(), []
                    ordinal += 1
        if data:
            yield row(len(data))

    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    ordered = rows.repartitionByRange("i").sortWithinPartitions("i", "t").mapInArrow(run, _RAW)
    first = F.get(F.col("documents"), F.lit(0))["ordinal"]
    data = blocks.encode(F.col("raw"), F.size("documents"), first).alias("data")
    ordered.select("part", "block", "start", "n", "documents", data).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document."""
    blocks.install(spark)
    files = spark.read.schema(FILES).parquet(folder)
    piece = lambda raw, d: F.struct(d["doc_id"].alias("doc_id"), d["ordinal"].alias("ordinal"), d["at"].alias("at"), d["n"].alias("n"), F.crc32(F.substring(raw, 4 * d["at"] + 1, 4 * d["n"])).alias("crc"))
    # the decoded ids are bound to a variable: each block is decoded once, whatever the pieces in it
    decoded = F.get(F.transform(F.array(blocks.decode(F.col("data"))), lambda raw: F.transform("documents", lambda d: piece(raw, d))), F.lit(0))
    pieces = files.select("part", "block", F.col("start").alias("first"), F.inline(decoded))
    place = F.struct("block", "n", "crc")
    found = pieces.groupBy("part", "ordinal").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.min(F.col("first") + F.col("at")).alias("first"), F.sort_array(F.collect_list(place)).alias("pieces"))
    sizes = files.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    lengths = F.transform("pieces", lambda p: 4 * p["n"].cast("long"))
    total = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["n"])
    crc = F.when(F.size("pieces") == 1, F.get("pieces", F.lit(0))["crc"]).otherwise(blocks.joined(F.col("pieces.crc"), lengths))
    return found.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), total.alias("n_tokens"), crc.alias("ids_crc32"))
