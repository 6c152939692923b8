"""Character statistics of texts and the tests for garbled ones, as columns.

Lengths are in code points. Runs of three or more full stops are leaders, not content.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code point classes, valid in Java's regular expressions and in RE2.
CLASSES = {
    "cjk": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{FF01}-\x{FF60}",
    "replacement": r"\x{FFFD}",
    "private_use": r"\x{E000}-\x{F8FF}",
    "control": r"\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{FFFE}\x{FFFF}",
    "ascii_letter": "A-Za-z",
    "odd_latin": r"\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}",
    "odd_script": r"\x{370}-\x{4FF}",
    "odd_box": r"\x{2500}-\x{25FF}",
}
CONSONANT = "B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z"
EDGE = r"[\s.\x{B7}\x{2026}\x{2025}_\x{2212}-]+"
WORDLIKE = r"[0-9A-Za-z\x{C0}-\x{24F}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"


@dataclass(frozen=True)
class Gate:
    """Thresholds of the garbled tests."""

    least_visible: int = 40
    replacement: float = 0.02
    private_use: float = 0.02
    control: float = 0.05
    odd_latin: float = 0.5
    odd_box: float = 0.3
    letters: int = 60
    no_vowel: float = 0.25
    relative_visible: int = 200
    base_cjk: float = 0.3
    ascii_share: float = 0.5
    base_odd: float = 0.03
    odd: float = 0.12


NAMES = ("visible", *CLASSES, "letter_runs", "no_vowel")
_SPACE, _STOP, _VOWEL, _OTHER = "space", "stop", "vowel", "other"
_MARKS = (*CLASSES, _SPACE, _STOP, _VOWEL, _OTHER)  # a code point has one of them


@cache
def _marks() -> np.ndarray:
    """The mark of each code point up to U+FFFF; one more entry stands for all beyond."""
    of = {name: k for k, name in enumerate(_MARKS)}
    out = np.full(0x10001, of[_OTHER], np.uint8)
    for name, spec in CLASSES.items():
        spec = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\U{int(m[1], 16):08X}", spec)
        found = re.compile(f"[{spec}]")
        out[[c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and found.match(chr(c))]] = of[name]
    for name, characters in ((_SPACE, " \t\n\r"), (_STOP, "."), (_VOWEL, "AEIOUaeiou")):
        out[[ord(c) for c in characters]] = of[name]
    return out


def _in_runs(inside: np.ndarray, least: int) -> np.ndarray:
    """Marks the code points of runs of at least ``least``: what is left of the marks when each must be
    followed by ``least - 1`` more, spread back over as many. The steps double."""
    out = inside
    for back in (False, True):
        wide = 1
        while wide < least:
            step = min(wide, least - wide)
            moved = np.zeros_like(out)
            if back:
                moved[step:] = out[:-step]
                out = out | moved
            else:
                moved[:-step] = out[step:]
                out = out & moved
            wide += step
    return out


def _sums(inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text how many of its code points are marked."""
    return np.add.reduceat(inside.view(np.uint8), starts, dtype=np.int64)


def count(texts: list[str]) -> dict[str, np.ndarray]:
    """The counters of texts, from one look at their code points."""
    whole = "\n".join(texts) + "\n"
    try:
        marks = np.frombuffer(whole.encode("latin-1").translate(_marks()[:256].tobytes()), np.uint8)
    except UnicodeEncodeError:
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        marks = np.take(_marks(), np.minimum(points, 0x10000))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1  # the first code point of each; a line feed follows each text
    is_ = {name: marks == k for k, name in enumerate(_MARKS) if name != _OTHER}
    none = np.zeros(len(texts), np.int64)
    out = {name: _sums(is_[name], starts) if is_[name].any() else none for name in CLASSES}
    letter, stops = is_["ascii_letter"] | is_[_VOWEL], is_[_STOP]
    leaders = _in_runs(stops, 3)
    out["visible"] = sizes + 1 - _sums(is_[_SPACE], starts) - (_sums(leaders, starts) if leaders.any() else 0)
    consonants = _in_runs(is_["ascii_letter"], 8)
    out["letter_runs"] = _sums(_in_runs(letter, 6), starts)
    out["no_vowel"] = _sums(consonants, starts) if consonants.any() else none
    out["ascii_letter"] = _sums(letter, starts)
    return out


def garbled(found: dict[str, np.ndarray], gate: Gate = Gate()) -> np.ndarray:
    """Whether a text fails any test that needs no baseline; ``found`` are the counters of texts."""
    seen = np.maximum(found["visible"], 1)
    bad = (found["no_vowel"] >= gate.no_vowel * np.maximum(found["letter_runs"], 1)) & (found["letter_runs"] > 0) & (found["ascii_letter"] >= gate.letters)
    for name in ("replacement", "private_use", "control", "odd_latin", "odd_box"):
        bad |= found[name] >= getattr(gate, name) * seen
    return bad & (found["visible"] >= gate.least_visible)


def counted(df: DataFrame, text: str, *keep: str, piece: int = 1_000_000) -> DataFrame:
    """Columns ``keep`` and the counters of each row's text; a null text counts as empty.

    The counters are a dozen tests of every character. As expressions each is a pass that builds a new
    string; here an Arrow batch's code points are looked up once, in a table, and counted by class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = b.column(len(keep)).to_pylist(), 0
            while at < len(texts):
                end = size = 0
                own = []
                for end in range(at, len(texts)):
                    own.append(texts[end] or "")
                    size += len(own[-1])
                    if size >= piece:
                        break
                found = count(own)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, len(own)) for i in range(len(keep))), *(pa.array(found[k], pa.int64()) for k in NAMES)], [*keep, *NAMES])
                at = end + 1

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep) + ", ".join(f"{k} long" for k in NAMES)
    return df.select(*keep, F.col(text).cast("string")).mapInArrow(run, schema)


def share(part: str | Column, whole: str | Column = "visible") -> Column:
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def absolute(gate: Gate = Gate()) -> dict[str, Column]:
    """Reasons over the counters that need no baseline; null-safe booleans."""
    enough = F.col("visible") >= gate.least_visible
    return {
        "replacement": enough & (share("replacement") >= gate.replacement),
        "private_use": enough & (share("private_use") >= gate.private_use),
        "control": enough & (share("control") >= gate.control),
        "odd_latin": enough & (share("odd_latin") >= gate.odd_latin),
        "odd_box": enough & (share("odd_box") >= gate.odd_box),
        "no_vowel": enough & (F.col("ascii_letter") >= gate.letters) & (share("no_vowel", "letter_runs") >= gate.no_vowel),
    }


def odd() -> Column:
    return F.col("odd_latin") + F.col("odd_script") + F.col("odd_box")


def relative(base_cjk: Column, base_odd: Column, gate: Gate = Gate()) -> dict[str, Column]:
    """Reasons against the ratios of the whole that a page belongs to."""
    enough = F.col("visible") >= gate.relative_visible
    return {
        "low_cjk": enough & (base_cjk > gate.base_cjk) & (share("cjk") < base_cjk / 3) & (share("ascii_letter") < gate.ascii_share),
        "odd": enough & (base_odd < gate.base_odd) & (share(odd()) >= gate.odd),
    }


def stripped_lines(text: Column) -> Column:
    """Lines without white space and leader characters at their ends."""
    bare = lambda line: F.regexp_replace(line, f"^{EDGE}|{EDGE}$", "")
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), bare)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it reads more than once, bound to a variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def upper_each(text: Column) -> Column:
    """Upper case of each character by itself, so that a text keeps its number of characters: a letter whose
    capital form has several has the single one (ẞ) or, without any, itself."""

    def one(c: Column) -> Column:
        up, title = F.upper(c), F.initcap(c)
        return F.when(c == "ß", "ẞ").when(F.length(up) == 1, up).when(F.length(title) == 1, title).otherwise(c)

    return F.when(F.length(F.upper(text)) == F.length(text), F.upper(text)).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def repeated_lines(text: Column) -> Column:
    """Struct of the number of meaningful lines, and of those that occur more than once (every
    occurrence counts).

    The lines are sorted, so that equal ones stand side by side; no line leaves its row.
    """
    lines = F.array_sort(F.filter(stripped_lines(text), lambda x: (F.length(x) >= 4) & x.rlike(WORDLIKE)))

    def counts(lines: Column) -> Column:
        beside = lambda x, i: F.coalesce(F.get(lines, i - 1) == x, F.lit(False)) | F.coalesce(F.get(lines, i + 1) == x, F.lit(False))
        return F.struct(F.size(lines).alias("lines"), F.size(F.filter(lines, beside)).alias("repeated"))

    return _once(lines, counts)


def short_lines(text: Column) -> Column:
    """Struct of the number of lines with content, and of those of at most two characters that are not
    numbers."""
    lines = F.filter(stripped_lines(text), lambda x: x != "")
    return _once(lines, lambda x: F.struct(F.size(x).alias("lines"), F.size(F.filter(x, lambda y: (F.length(y) <= 2) & ~y.rlike("^[0-9]+$"))).alias("short")))
