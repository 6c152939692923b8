r"""Operator 4: quality rules as a short-circuit cascade, in DataFrame functions alone.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage
return. The base measures are counted for every text. The further rules form a cascade: the share of
texts that each rule rejects and the time it takes are measured on a random sample, and the rules run in
descending order of rejections per second, each only on texts that no earlier one rejected. The order
decides speed alone, not the verdict.

Null text counts as having no words: all counts are 0, the base fails and the row is not kept. Empty
texts are the same. Repeated rows are judged each on its own; other columns do not matter.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import materialise

WHITE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it needs more than once: bound to a variable, so that no optimiser rule
    can put the value's expression in each place that reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def measures(text: Column) -> Column:
    """Struct of t, words, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""

    def windows(h: Column) -> Column:
        spot = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.when(F.size(h) >= WINDOW, F.transform(spot, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))

    def repeated(words: Column) -> Column:
        some = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))
        return once(F.transform(words, lambda w: F.xxhash64(w)), lambda h: once(windows(h), some))

    def counted(t: Column, words: Column, lines: Column) -> Column:
        return F.struct(
            t.alias("t"),
            words.alias("words"),
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated(words).cast("long").alias("n_repeat_words"),
        )

    def split(t: Column) -> Column:
        words = F.filter(F.split(t, WHITE), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD_CHAR))
        return once(words, lambda w: once(lines, lambda x: counted(t, w, x)))

    return once(F.coalesce(text.cast("string"), F.lit("")), split)


def covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sorted hashes show the repeats side by side."""
    by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeats(ordered: Column) -> Column:
        as_beside = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(ordered, lambda x, k: as_beside(x, k - 1) | as_beside(x, k + 1))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def width(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, s: total + s)

    return once(once(by_hash, repeats), width)


@dataclass
class Rule:
    """A test of a text's measures that is true for texts to reject."""

    name: str
    rejects: Callable[[Column], Column]
    rate: float = 0.0
    seconds: float = 0.0


@dataclass
class Cascade:
    rules: list[Rule] = field(default_factory=lambda: default_rules())

    def ordered(self) -> list[Rule]:
        return sorted(self.rules, key=lambda r: (-r.rate / max(r.seconds, 1e-9), r.name))

    def estimate(self, docs: DataFrame, text: str = "text", sample_rows: int = 1000, repeats: int = 3) -> Cascade:
        """Measures each rule's time and rejections on a sample of about ``sample_rows`` rows.

        A rule runs once to be compiled, then over ``repeats`` copies of the sample; the time that a rule
        which tests nothing takes there, scheduling and reading, is taken off.
        """
        n = docs.count()
        if n:
            part = docs.select(F.col(text).alias("text"))
            part = part.sample(fraction=sample_rows / n, seed=11) if n > sample_rows else part
            part = materialise(part.select(measures(F.col("text")).alias("m")), "sample")
            part = part.select("m", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("copy"))

            def timed(rejects: Callable[[Column], Column]) -> tuple[float, float]:
                test = part.agg(F.avg(F.coalesce(rejects(F.col("m")) & (F.col("copy") > 0), F.lit(False)).cast("double")))
                test.first()
                began = time.perf_counter()
                rate = test.first()[0] or 0.0
                return time.perf_counter() - began, rate

            nothing, _ = timed(lambda m: F.isnull(m["n_words"]))
            for r in self.rules:
                took, r.rate = timed(r.rejects)
                r.seconds = max(took - nothing, 1e-3)
        return self

    def keeps(self, m: Column) -> Column:
        verdict = None
        for r in self.ordered():
            verdict = F.when(r.rejects(m), False) if verdict is None else verdict.when(r.rejects(m), False)
        return F.lit(True) if verdict is None else verdict.otherwise(True)


def default_rules() -> list[Rule]:
    """Over the measures: symbols, letters, capitals, length of words, repeated lines and words."""
    letters = lambda m: F.length(F.regexp_replace(m["t"], r"\P{L}+", ""))
    capitals = lambda m: F.length(F.regexp_replace(m["t"], r"\P{Lu}+", ""))
    same = lambda m: F.aggregate(m["words"], F.struct(F.lit("").alias("w"), F.lit(0).alias("n")), lambda a, w: F.struct(w.alias("w"), (a["n"] + (a["w"] == w).cast("int")).alias("n")), lambda a: a["n"])
    return [
        Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
        Rule("letters", lambda m: 10 * letters(m) < 3 * m["word_chars"]),
        Rule("capitals", lambda m: 10 * capitals(m) > 9 * m["word_chars"]),
        Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
        Rule("repeated_lines", lambda m: (m["n_lines"] >= 10) & (2 * m["n_dup_lines"] > m["n_lines"])),
        Rule("repeated_words", lambda m: 2 * same(m) > m["n_words"]),
    ]


def judge(docs: DataFrame, text: str = "text", sample_rows: int = 1000) -> DataFrame:
    """All columns of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and kept. Columns of ``docs`` with these names give way to the new ones."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    new = [*counts, "base_failed", "kept"]
    rest = [c for c in docs.columns if c.lower() not in new]
    cascade = Cascade().estimate(docs, text, sample_rows)

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        passed = lambda f: F.struct(*(m[c].alias(c) for c in counts), f.alias("base_failed"), F.when(f, False).otherwise(cascade.keeps(m)).alias("kept"))
        return once(failed, passed)

    own = next(x for x in (f"judged{'_' * k}" for k in range(len(rest) + 1)) if x not in {c.lower() for c in rest})
    named = [F.col(f"`{c}`") for c in rest]
    judged = docs.select(*named, once(measures(F.col(text)), verdict).alias(own))
    return judged.select(*named, *(F.col(own)[c].alias(c) for c in new))
