r"""Cached encoding of texts by spans that no pre-token crosses.

A span is a space or line feed followed by a non-space character, up to the next such place. The
pre-token pattern of byte-level BPE always starts a pre-token at a space that a non-space character
follows, and makes a line feed in that place a pre-token of its own. So a text's ids are the ids of
its spans, one after the other, and a span's ids depend on nothing but the span.
"""

from __future__ import annotations

import array
import gc
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lakeloom.llm.common import returned, single_threaded, tenant

_HEAD = "\0 "  # holds the first span's place; no span has a space in it
_SAFE = re.compile(r" (?=\S)")


def _unsafe(p: str) -> bool:
    return not p or p[0].isspace() and (p[0] != "\n" or p[1:2].isspace() or len(p) == 1)


class SpanEncoder:
    """Values of spans from two generations of a bounded cache; misses are encoded in batches.

    ``encode`` gives the value of each of a list of strings; ``known`` is an optional first tier that
    is never evicted. At most ``2 * room`` further values are held.
    """

    def __init__(self, encode: Callable[[list[str]], list], room: int = 150_000, known: dict | None = None):
        self.encode, self.room, self.known = encode, room, known or {}
        self.plainer = getattr(encode, "plainer", None)
        self.young: dict = {}
        self.old: dict = {}

    def _fill(self, missing: set[str]) -> None:
        young, old = self.young, self.old
        fresh = []
        for p in missing:
            v = old.get(p)
            if v is None:
                fresh.append(p)
            else:
                young[p] = v
        values = self.encode([p if p[0] == "\n" else " " + p for p in fresh]) if fresh else []
        young.update(zip(fresh, values))

    def batch(self, texts: list[str]) -> Iterator[list]:
        """For each text the values of its spans, in order.

        A text is cut at spaces and before line feeds; where a part then starts with white space
        otherwise, and so may not be a span, the text is cut at safe spaces alone.
        """
        young = self.young
        first = (self.known or young).get
        split, missing, heads = [], set(), {}
        for t in texts if self.plainer is None else map(self.plainer, texts):
            parts = t.replace("\n", " \n").split(" ")
            head, parts[0] = parts[0], _HEAD
            values = list(map(first, parts))
            gaps = [i for i, v in enumerate(values) if v is None and i]
            if gaps and any([_unsafe(parts[i]) for i in gaps]):
                parts = _SAFE.split(t)
                head, parts[0] = parts[0], _HEAD
                values = list(map(first, parts))
                gaps = [i for i, v in enumerate(values) if v is None and i]
            open_gaps = []
            for i in gaps:
                p = parts[i]
                v = young.get(p)
                if v is None:
                    missing.add(p)
                    open_gaps.append((i, p))
                else:
                    values[i] = v
            heads[head] = None
            split.append((head, values, open_gaps))
        if missing:
            self._fill(missing)
        got = [h for h in heads if h]
        heads.update(zip(got, self.encode(got)))
        for head, values, open_gaps in split:
            for i, p in open_gaps:
                values[i] = young[p]
            if head:
                values[0] = heads[head]
            else:
                del values[0]
            yield values
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}

    def all(self, texts: list[str], chars: int = 2_000_000) -> Iterator[list]:
        """As batch(), over pieces of the list of about ``chars`` characters."""
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= chars:
                yield from self.batch(texts[start : i + 1])
                start, size = i + 1, 0
        if start < len(texts):
            yield from self.batch(texts[start:])


class SpanTable:
    """Token counts of texts, and their ids, by one lookup for each distinct span of a batch.

    Arrow cuts a batch's texts and numbers their spans; Python sees each distinct span once a batch and
    keeps the values of at most about ``room`` spans; numpy puts the texts' values together. ``known`` is a
    first tier of spans' lengths, for counts. Texts that may not be cut at every space go the longer way.
    """

    def __init__(self, encoder: SpanEncoder, ids: bool):
        self.encoder, self.ids = encoder, ids
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.size, self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _add(self, spans: list[str], values: list) -> None:
        n = len(self.place)
        self.place.update(zip(spans, range(n, n + len(spans))))
        size, flat = self._packed(values)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])

    def _packed(self, values: list) -> tuple[np.ndarray, np.ndarray]:
        if not self.ids:
            return np.array(values, np.int64), np.zeros(0, np.uint32)
        flat = np.frombuffer(b"".join(values), "<u4")
        return np.fromiter(map(len, values), np.int64, len(values)) // 4, flat

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and (where ids are wanted) all ids, one text after the other."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        plainer, known = self.encoder.plainer, self.encoder.known
        cut = pc.replace_substring(pa.array(texts if plainer is None else list(map(plainer, texts)), pa.large_string()), "\n", " \n")
        parts = pc.split_pattern(cut, " ")
        first = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        spans = parts.flatten().dictionary_encode()
        of = spans.indices.to_numpy().astype(np.int64)
        inner = np.ones(len(of), bool)
        inner[first] = False
        used = np.bincount(of[inner], minlength=len(spans.dictionary)) > 0
        names, where = spans.dictionary.to_pylist(), np.full(len(used), -1, np.int64)
        wanted = np.flatnonzero(used).tolist()
        found = [self.place.get(names[i], -1) for i in wanted]
        fresh = [i for i, k in zip(wanted, found) if k < 0]
        where[wanted] = found
        odd = [i for i in fresh if _unsafe(names[i])]
        if odd:
            bad = set(odd)
            fresh = [i for i in fresh if i not in bad]
        if fresh:
            new = [names[i] for i in fresh]
            more = [i for i, p in enumerate(new) if known.get(p) is None]
            values = [known.get(p) for p in new]
            for i, v in zip(more, self.encoder.encode([new[i] if new[i][0] == "\n" else " " + new[i] for i in more]) if more else []):
                values[i] = v
            where[fresh] = np.arange(len(self.place), len(self.place) + len(fresh))
            self._add(new, values)
        heads = [names[i] for i in of[first].tolist()]
        distinct = sorted({h for h in heads if h})
        size, flat = self._packed(self.encoder.encode(distinct) if distinct else [])
        begin = len(self.flat) + np.cumsum(size) - size
        at = {h: len(self.size) + i for i, h in enumerate(distinct)} | {"": len(self.size) + len(distinct)}
        slot = where[of]
        slot[first] = [at[h] for h in heads]
        sizes, starts = np.concatenate([self.size, size, [0]]), np.concatenate([self.start, begin, [0]])
        slow = np.zeros(len(texts), bool)
        if odd:
            slow = np.add.reduceat((slot < 0).view(np.uint8), first, dtype=np.int64) > 0
            slot[slot < 0] = len(sizes) - 1
        own = sizes[slot]
        counts = np.add.reduceat(own, first)
        ids = self._gather(np.concatenate([self.flat, flat]), starts[slot], own) if self.ids else self.flat
        if slow.any():
            counts, ids = self._mended(texts, slow, counts, ids)
        if len(self.place) > self.encoder.room:
            self._keep([names[i] for i in wanted if where[i] >= 0])
        return counts, ids

    @staticmethod
    def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.uint32)
        kind = np.int32 if max(len(flat), int(ends[-1])) < 1 << 30 else np.int64
        place = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
        place += np.arange(ends[-1], dtype=kind)
        return flat[place]

    def _mended(self, texts: list[str], slow: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts in the values of texts that are cut at safe spaces alone."""
        rows = np.flatnonzero(slow)
        values = list(self.encoder.all([texts[i] for i in rows]))
        if not self.ids:
            counts[rows] = [sum(v) for v in values]
            return counts, ids
        begin = np.cumsum(counts) - counts
        pieces, at = [], 0
        for i, v in zip(rows.tolist(), values):
            own = np.frombuffer(b"".join(v), "<u4")
            pieces += [ids[at : begin[i]], own]
            at = begin[i] + counts[i]
            counts[i] = len(own)
        return counts, np.concatenate([*pieces, ids[at:]])

    def _keep(self, spans: list[str]) -> None:
        """Forgets all but the spans of the last batch."""
        slots = np.array([self.place[p] for p in spans], np.int64)
        size, flat = self.size[slots], self._gather(self.flat, self.start[slots], self.size[slots]) if self.ids else self.flat
        self.place = dict(zip(spans, range(len(spans))))
        self.size, self.start, self.flat = size, np.cumsum(size) - size, flat

    def batches(self, texts: list[str], chars: int = 4_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As encode(), over pieces of the list of about ``chars`` characters: the place of the first text,
        counts and ids."""
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= chars or i == len(texts) - 1:
                yield (start, *self.encode(texts[start : i + 1]))
                start, size = i + 1, 0
                returned()


# Bytes below 33, and those that white space beyond ASCII starts with.
_MAYBE_SPACE = np.isin(np.arange(256), [*range(33), 0xC2, 0xE1, 0xE2, 0xE3])


class JoinedSpans(SpanTable):
    """Ids of texts by one call of the engine for all distinct spans of a batch, without a table of spans.

    Arrow cuts and numbers the spans, as above. Those without further white space are joined by line feeds:
    between spans a line feed is a pre-token of its own, so its id, which no other span has, shows where one
    ends. The rest (special strings, odd white space) and vocabularies that the engine does not fit go the
    longer ways. Nothing is kept from batch to batch but the spans of texts that go the longest way.
    """

    def __init__(self, encoder: SpanEncoder):
        super().__init__(encoder, True)
        merger = getattr(encoder.encode, "merger", None)
        feed = merger.engine.encode_ordinary("\n") if merger else []
        self.feed = feed[0] if len(feed) == 1 else None
        if self.feed is not None:
            self.special, self.engine = merger.special, merger.joining()

    def texts(self, column: pa.Array, size: int = 8_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of texts, null as empty, in pieces of about ``size`` bytes: the place of the first, counts and ids."""
        if self.feed is None:
            yield from self.batches([t or "" for t in column.to_pylist()])
            return
        column = pc.fill_null(column.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(column).to_numpy())
        start = 0
        while start < len(column):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield (start, *self.joined(column.slice(start, stop - start)))
            start = stop
            returned()

    def joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids, one text after the other."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        first = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        spans = parts.flatten().dictionary_encode()
        of, names = spans.indices.to_numpy(), spans.dictionary
        del parts, spans
        plain, fed, alone, unsafe = self._sorted(names)
        own = self._split(names.take(pa.array(plain)) if len(plain) < len(names) else names, "\n ", " ")
        led = self._split(names.take(pa.array(fed)), "", "")
        other = names.take(pa.array(alone)).to_pylist()
        other = self._packed(self.encoder.encode([p if p[0] == "\n" else " " + p for p in other]) if other else [])
        heads = names.take(pa.array(of[first])).dictionary_encode()
        distinct = heads.dictionary.to_pylist()
        full = [h for h in distinct if h]
        values = iter(self.encoder.encode(full) if full else [])
        start_of = self._packed([next(values) if h else b"" for h in distinct])
        groups = [own, led, other, start_of]
        sizes = np.concatenate([size for size, _ in groups])
        starts, flat = np.cumsum(sizes) - sizes, np.concatenate([ids for _, ids in groups])
        slot = np.full(len(names), len(sizes), np.int64)  # the last, beyond all: a span without ids
        slot[np.concatenate([plain, fed, alone])] = np.arange(len(plain) + len(fed) + len(alone))
        slot = slot[of]
        slot[first] = len(sizes) - len(distinct) + heads.indices.to_numpy()
        sizes, starts = np.append(sizes, 0), np.append(starts, 0)
        each = sizes[slot]
        counts, ids = np.add.reduceat(each, first), self._gather(flat, starts[slot], each)
        if len(unsafe):
            bad = slot == len(sizes) - 1
            slow = np.add.reduceat(bad.view(np.uint8), first, dtype=np.int64) > 0
            if slow.any():
                counts, ids = self._mended(texts.to_pylist(), slow, counts, ids)
        return counts, ids

    def _sorted(self, names: pa.Array) -> list[np.ndarray]:
        """Places of spans without white space, of those with nothing of it but a first line feed, of others
        that are to be encoded alone, and of parts that may not be spans."""
        offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
        data = np.frombuffer(names.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        kind = np.zeros(len(names), np.uint8)
        found = np.searchsorted(offsets, np.flatnonzero(_MAYBE_SPACE[data]) + offsets[0], "right") - 1
        look = np.unique(np.concatenate([found, np.flatnonzero(np.diff(offsets) == 0)]))
        for i, p in zip(look.tolist(), names.take(pa.array(look)).to_pylist()):
            if _unsafe(p):
                kind[i] = 3
            elif any(map(str.isspace, p[1:])):
                kind[i] = 2
            elif p[0] == "\n":
                kind[i] = 1
        for x in self.special:
            has = pc.match_substring(names, x).to_numpy(zero_copy_only=False)
            kind[has & (kind < 2)] = 2
        return [np.flatnonzero(kind == k) for k in range(4)]

    def _split(self, names: pa.Array, between: str, before: str) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of spans that are encoded as one text, where each has or follows a line feed."""
        if not len(names):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        text = before + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.scalar(between, pa.large_string()))[0].as_py()
        ids = np.frombuffer(array.array("I", self.engine.encode_ordinary(text)), np.uint32)
        feeds = np.flatnonzero(ids == self.feed)
        if between:
            sizes = np.diff(np.concatenate([[-1], feeds, [len(ids)]])) - 1
            ids = ids[ids != self.feed]
        else:
            sizes = np.diff(np.append(feeds, len(ids)))
        if len(sizes) != len(names):
            raise AssertionError("a span's ids hold a line feed")
        return sizes, ids


def gathered(batches: Iterator[pa.RecordBatch], column: int, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches put together until a column's texts have about ``size`` bytes: the more texts are looked at
    at once, the fewer distinct spans there are for each."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.column(column).nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


# Fixed value: how byte-level BPE of the tokenizers library cuts a text before it merges.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUNS = r"|\s+(?!\S)|\s+"  # its end
_END = b"\xff"  # stands for a word's end; no text in UTF-8 has this byte


class _Merger:
    """Merges spans as the tokenizers library does by its file, with the faster engine of tiktoken.

    Merging by the rank of what results equals merging by a list of pairs, if ids grow along that list:
    until a token's turn comes, every part of a text with its bytes and its ends has been cut alike.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path) as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps, normal, model = spec["pre_tokenizer"] or {}, spec["normalizer"], spec["model"]
        self.lower, pattern = False, None
        if normal is None and steps.get("type") == "ByteLevel" and steps["use_regex"] and not steps["add_prefix_space"]:
            pattern = BYTE_LEVEL
        elif normal and steps.get("type") == "Sequence" and {x["type"] for x in normal["normalizers"]} == {"NFC", "Replace", "Lowercase"}:
            split = steps["pretokenizers"][0]
            if split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"]:
                self.lower, pattern = True, split["pattern"]["Regex"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in merges]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
        self.fits = bool(pattern) and plain and order == sorted(order) and self.lower == (model.get("end_of_word_suffix") == "</w>")
        if self.fits:
            ranks = {_bytes(t, self.lower): i for t, i in model["vocab"].items() if t not in self.special}
            self.find = regex.compile(pattern).findall
            self.engine = tiktoken.Encoding("spans", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.cache: dict[str, list[int]] = {}

    def joining(self):
        """An engine for texts whose only white space is line feeds, alone or before one space: there the
        pattern needs no look at what follows, which its expressions are slow at."""
        import tiktoken

        ranks = self.engine._mergeable_ranks
        return tiktoken.Encoding("joined", pat_str=BYTE_LEVEL.replace(_RUNS, r"|\s"), mergeable_ranks=ranks, special_tokens={})

    def plainer(self, text: str) -> str:
        """A text with the same ids in which more spans are alike, if that is sure: case and line feeds
        do not matter to a vocabulary of lower-cased words."""
        if "<|" in text or any(x in text for x in self.special):
            return text
        low = text.lower()
        if not text.isascii() and (len(low) != len(text) or "\u03a3" in text or not unicodedata.is_normalized("NFC", text)):
            return text
        return low.replace("\n", " ")

    def ids(self, span: str) -> list[int] | None:
        """The span's ids; None where only the library can tell."""
        if "<" in span and any(x in span for x in self.special):
            return None
        if not self.lower:
            return self.engine.encode_ordinary(span)
        low = span.lower()
        if not span.isascii() and (len(low) != len(span) or "\u03a3" in span or not unicodedata.is_normalized("NFC", span)):
            return None
        out, cache = [], self.cache
        for piece in self.find(low):
            ids = cache.get(piece)
            if ids is None:
                if len(cache) > 200_000:
                    cache.clear()
                ids = cache[piece] = self.engine._encode_single_piece(piece.encode() + _END)
            out += ids
        return out


def _bytes(token: str, ends: bool) -> bytes:
    """The bytes of a token of a byte-level vocabulary, where printable characters stand for bytes."""
    word = ends and token.endswith("</w>")
    return bytes(_letters()[c] for c in (token[:-4] if word else token)) + (_END if word else b"")


@cache
def _letters() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def library_encoder(path: str, what: str) -> Callable[[list[str]], list]:
    """Encodes spans as the tokenizers library: ids as little-endian bytes, or their number."""
    from tokenizers import Tokenizer

    single_threaded()
    merger = _Merger(path)
    gc.collect()
    returned()  # what reading the file took
    known: list[Tokenizer] = []

    def tokenizer() -> Tokenizer:
        """The library's own, from when it is first needed."""
        if not known:
            known.append(Tokenizer.from_file(path))
            known[0].no_padding()
            known[0].no_truncation()
        return known[0]

    value = len if what == "lengths" else (lambda ids: array.array("I", ids).tobytes())

    def library(texts: list[str]) -> list:
        return [e.ids for e in tokenizer().encode_batch_fast(texts, add_special_tokens=False)]

    def encode(spans: list[str]) -> list:
        if not merger.fits:
            return list(map(value, library(spans)))
        found = list(map(merger.ids, spans))
        rest = [s for s, ids in zip(spans, found) if ids is None]
        more = iter(library(rest) if rest else [])
        return [value(next(more) if ids is None else ids) for ids in found]

    if merger.fits and merger.lower:
        encode.plainer = merger.plainer
    elif merger.fits:
        encode.merger = merger
    return encode


_kept: dict = {}


def worker_joiner(path: str, room: int) -> JoinedSpans:
    """This worker's encoder of ids by joined spans, which outlasts the task."""
    tenant("spans", _kept.clear)
    key = (path, "joined", room)
    if key not in _kept:
        _kept.clear()
        _kept[key] = JoinedSpans(SpanEncoder(library_encoder(path, "ids"), room))
    return _kept[key]


def worker_encoder(path: str, what: str, room: int, known: dict | None = None) -> SpanTable:
    """This worker's encoder of ``ids`` or ``lengths``, whose caches outlast the task."""
    tenant("spans", _kept.clear)
    key = (path, what, room, (len(known), hash(frozenset(known.items()))) if known else None)
    if key not in _kept:
        _kept.clear()
        _kept[key] = SpanTable(SpanEncoder(library_encoder(path, what), room, known), what == "ids")
    return _kept[key]
