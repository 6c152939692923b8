"""Operator 5: token ids in blocks that are coded independently of each other.

A block starts with fresh models and can be decoded alone. Its ids are coded by a range coder under an
adaptive mixture of predictions of order 0, 1 and 2; ``token_blocks.java`` has the models. The frame before
the payload names the bits of an id, the ids, the documents that end in the block, the bytes of payload,
the first document's ordinal and the CRC-32 of the ids, little-endian.

The coder is a chain of dependent steps, which no vector of lanes shortens, so it runs in the JVM, in the
tasks that write and read the blocks. Ids of 2^31 and more are refused, and so are damaged blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import jvm

MOST = 16_384  # ids of a block
FUNCTIONS = {
    "lakeloom_encode_block": ("lakeloom.llm.EncodeBlock", "binary"),
    "lakeloom_decode_block": ("lakeloom.llm.DecodeBlock", "binary"),
    "lakeloom_join_checksums": ("lakeloom.llm.JoinChecksums", "bigint"),
}


def install(spark: SparkSession) -> None:
    jvm.install(spark, "token_blocks.java", FUNCTIONS)


def encode(ids: Column, documents: Column, first: Column) -> Column:
    """A framed block of ids, given as little-endian unsigned 32-bit integers."""
    return F.call_function("lakeloom_encode_block", ids, documents.cast("int"), first.cast("long"))


def decode(block: Column) -> Column:
    """The ids of a framed block, as they were given; fails on a damaged one."""
    return F.call_function("lakeloom_decode_block", block)


def joined(checksums: Column, lengths: Column) -> Column:
    """CRC-32 of data from those of its pieces, in order, and their lengths in bytes."""
    return F.call_function("lakeloom_join_checksums", checksums, lengths)
