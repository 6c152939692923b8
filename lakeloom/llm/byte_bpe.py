"""Operator 3: byte-level BPE encoding and decoding.

Each match of the pre-token pattern is merged on its own. A segment tree over the byte positions holds,
for each live token, the rank of the pair that it forms with its right neighbour; its root is the
leftmost pair of least rank. A merge changes three leaves (the token, the one it swallowed, its left
neighbour), each in logarithmic time. Ids of pre-tokens and spans are kept in bounded worker caches.

Null text counts as empty: no ids, no bytes. Empty tables give empty results; other columns do not
matter. Every text decodes to its own bytes.
"""

from __future__ import annotations

import array
import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import tenant
from lakeloom.llm.spans import SpanEncoder

_NONE = 1 << 62
_POS = (1 << 32) - 1
_FAN = 16  # children of a node: a minimum over so few runs in native code
_workers: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file whose lines are a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    rank = ranks.get
    leaves = [_NONE] * (n - 1)
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            leaves[i] = r << 32 | i
    tree = [leaves]
    while len(tree[-1]) > _FAN:
        tree.append([min(tree[-1][k : k + _FAN]) for k in range(0, len(tree[-1]), _FAN)])
    root, inner = tree[-1], tree[1:]
    end = list(range(1, n + 1))
    before = list(range(-1, n))

    def put(i: int, key: int) -> None:
        leaves[i] = key
        below = leaves
        for level in inner:
            i //= _FAN
            least = min(below[i * _FAN : (i + 1) * _FAN])
            if level[i] == least:
                return
            level[i] = least
            below = level

    while (top := min(root)) != _NONE:
        i = top & _POS
        j = end[i]
        stop = end[i] = end[j]
        before[stop] = i
        if j < n - 1:
            put(j, _NONE)
        if stop < n:
            r = rank(piece[i : end[stop]])
            put(i, _NONE if r is None else r << 32 | i)
        else:
            put(i, _NONE)
        if (p := before[i]) >= 0:
            r = rank(piece[p:stop])
            put(p, _NONE if r is None else r << 32 | p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids and back, with bounded caches."""

    def __init__(self, path: str, pattern: str, room: int = 150_000):
        import regex

        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.find = regex.compile(pattern).findall
        self.room, self.pieces = room, {}
        self.encoder = SpanEncoder(self._encode, room)

    def _encode(self, spans: list[str]) -> list[bytes]:
        out, pieces, ranks = [], self.pieces, self.ranks
        for span in spans:
            found = []
            for piece in self.find(span):
                ids = pieces.get(piece)
                if ids is None:
                    ids = pieces[piece] = array.array("I", merge(piece.encode(), ranks)).tobytes()
                found.append(ids)
            out.append(b"".join(found))
        if len(pieces) > self.room:
            pieces.clear()
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        return map(b"".join, self.encoder.all(texts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def _codec(path: str, pattern: str) -> Codec:
    tenant("byte_bpe", _workers.clear)
    if (path, pattern) not in _workers:
        _workers.clear()
        _workers[path, pattern] = Codec(path, pattern)
    return _workers[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (binary: little-endian unsigned 32-bit integers) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for b in batches:
            ids = list(codec.encode([t or "" for t in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The columns of ``encoded`` but ids, and decoded (binary): the bytes that the ids stand for."""
    rest = [c for c in encoded.columns if c not in (ids, "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for b in batches:
            out = pa.array([codec.decode(x or b"") for x in b.column(len(rest)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), out], [*rest, "decoded"])

    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in rest)
    return encoded.select(*rest, ids).mapInArrow(run, f"{schema}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 (lowercase hex) of the ids and of the bytes decoded from them.

    It is encode() and decode() in one pass, so that ids need not leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for b in batches:
            rows = [(len(ids) // 4, _hex(ids), _hex(codec.decode(ids))) for ids in codec.encode([t or "" for t in b.column(1).to_pylist()])]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
