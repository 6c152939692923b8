r"""Operator 7: licence scans by a trained paragraph classifier, in DataFrame functions alone.

A text's lines fall into blocks at lines without letter and digit (comment marks alone leave a line blank).
A paragraph is a run of lines of a block: a line, and up to REACH words in the lines after it, so notices
wrapped at any width are seen whole. A logistic regression over sparse word n-grams (one and two words)
tells licence families and the class ``unknown`` apart; its temperature is calibrated on held-back
examples, and a family is predicted only where its probability reaches the least that keeps unknown
paragraphs out there. A prediction counts once the family confirms it: enough of the words of one of its
TEMPLATES must occur in the paragraph, a word of KEYS among them, or one of its PHRASES as it stands. Of confirmed paragraphs
the best covered is taken first, then the shortest, and none that shares a line with one taken; where one of
several lines touches another of its family, both are one licence. So a line has one family, and an SPDX
expression of several gives the one that the classifier is sure of, if any.

Early, only runs with an anchor are let through, which loses nothing: of a template of n words of which m
must occur, any n - m + 1 words have one that occurs, and of a phrase any word; anchors are such words.

Training takes place on the driver, over the templates and sentences below. Null and empty texts have no
paragraphs and get no licence. Each row is scanned by its text alone, whatever its id, null and repeated
ones included; every row of the input is returned, and other columns do not matter. Of equally covered
paragraphs the shortest is taken, then the first. A line of any length is one line, never cut.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.quality import once

# Short notices of public licences, by family.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license version", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"],
    "apache": ["licensed under the apache license version", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses license", "this project is released under the apache license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "licensed under the bsd clause license", "released under the bsd license"],
    "cc-by": ["licensed under cc by", "this work is licensed under a creative commons attribution international license"],
    "cc-by-nc": ["licensed under cc by nc", "this work is licensed under a creative commons attribution noncommercial international license"],
    "cc-by-sa": ["licensed under cc by sa", "this work is licensed under a creative commons attribution sharealike international license"],
    "cc0": ["licensed under cc0 universal public domain dedication", "to the extent possible under law the author has waived all copyright and related rights to this work"],
    "gpl": ["this work is licensed under the gnu general public license version", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl": ["licensed under the gnu lesser general public license version", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license", "licensed under the mozilla public license version"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense license"],
}
# Sentences that speak of licences without being one.
OTHERS = ["the driver needs a license to drive the truck", "all rights reserved copyright by the author", "he lost his fishing license last year", "the new license fee will be paid by the public", "copyright law is a branch of law", "please read the terms of use", "free software is a matter of liberty", "permission to enter was not granted", "the license was revoked under the new law", "the city library is open to the public", "software version notes and changes", "spdx license identifier isc", "license identifier zlib", "license identifier epl", "released under the terms of the agreement", "the source code is in the public domain of discussion", "general public opinion about the work"]
# Short forms that count only word by word, SPDX identifiers among them.
PHRASES = {
    "agpl": ["license identifier agpl", "gnu affero general public license", "gnu agpl"],
    "apache": ["license identifier apache", "apache license"],
    "bsd": ["license identifier bsd", "bsd license", "bsd clause license"],
    "cc-by": ["license identifier cc by", "creative commons attribution license"],
    "cc-by-nc": ["license identifier cc by nc", "creative commons attribution noncommercial"],
    "cc-by-sa": ["license identifier cc by sa", "creative commons attribution sharealike"],
    "cc0": ["license identifier cc0", "cc0 universal"],
    "gpl": ["license identifier gpl", "gnu general public license", "gnu gpl"],
    "lgpl": ["license identifier lgpl", "gnu lesser general public license", "gnu library general public license", "gnu lgpl"],
    "mit": ["license identifier mit", "mit license"],
    "mpl": ["license identifier mpl", "mozilla public license"],
    "unlicense": ["license identifier unlicense", "unlicense license"],
}
# Of families whose templates are near another's, words of which a template needs one.
KEYS = {"agpl": ["affero"], "cc-by-nc": ["nc", "noncommercial"], "cc-by-sa": ["sa", "sharealike"], "gpl": ["general"], "lgpl": ["lesser"]}
COMMON = frozenset("a all and any are as at by can file following form forms free has in is it law may mit not of or other out permitted person possible program project provided public released related rights source subject terms that the this to under use version with without work you your".split())
REACH = 48  # words after a paragraph's first line; the longest template has 29
UNKNOWN = "unknown"
WORD = r"[^a-z0-9]+"


def words_of(line: Column) -> Column:
    """Lower-cased words of letters and digits; plain numbers and versions do not count."""
    return F.filter(F.split(F.lower(line), WORD), lambda w: (w != "") & ~w.rlike("^v?[0-9]+$"))


def _grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


class Classifier:
    """Softmax regression with weights by n-gram; class 0 is unknown."""

    def __init__(self, seed: int = 9, share: float = 0.6):
        self.share = share
        self.classes = [UNKNOWN, *sorted(TEMPLATES)]
        draw = random.Random(seed)
        fit, rest = self._examples(draw, 40), self._examples(draw, 12)
        own = sorted({g for x in (*TEMPLATES.values(), *PHRASES.values()) for t in x for g in _grams(t.split())})
        self.place = {g: i for i, g in enumerate(own)}
        self.weights = self._descend(*self._matrix(fit))
        x, y = self._matrix(rest)
        z = x @ self.weights
        self.sharpness = min((0.25, 0.5, 1.0, 2.0, 4.0), key=lambda s: -np.log(self._softmax(s * z)[np.arange(len(y)), y] + 1e-12).mean())
        p = self._softmax(self.sharpness * z)
        outside = p[y == 0, 1:].max(axis=1)
        self.least = float(min(0.9, max(0.5, np.quantile(outside, 0.99))))

    def _examples(self, draw: random.Random, each: int) -> list[tuple[list[str], int]]:
        """Paraphrases: words left out, others before and after. Of the class unknown: sentences that speak
        of licences, and paragraphs of words drawn from all of these, which is what a text looks like in
        which such words come by chance."""
        noise = sorted(COMMON | {w for t in OTHERS for w in t.split()})
        every = sorted({w for x in (*TEMPLATES.values(), *PHRASES.values()) for t in x for w in t.split()})
        out = []
        for k, family in enumerate(self.classes[1:], 1):
            for t in TEMPLATES[family] + PHRASES[family]:
                for _ in range(each):
                    words = [w for w in t.split() if draw.random() > 0.05]
                    before, after = ([draw.choice(noise) for _ in range(draw.randint(0, 3))] for _ in range(2))
                    out.append((before + words + after, k))
        for t in OTHERS:
            out += [([w for w in t.split() if draw.random() > 0.1], 0) for _ in range(each)]
        chance = lambda: [draw.choice(every if draw.random() < 0.15 else noise) for _ in range(draw.randint(4, 40))]
        return out + [(chance(), 0) for _ in range(each * 10)]

    def _matrix(self, rows: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(self.place) + 1))
        x[:, -1] = 1
        for i, (words, _) in enumerate(rows):
            for g in _grams(words):
                if g in self.place:
                    x[i, self.place[g]] = 1
        return x, np.array([k for _, k in rows])

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _descend(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, l2: float = 1e-3) -> np.ndarray:
        w = np.zeros((x.shape[1], len(self.classes)))
        want = np.eye(len(self.classes))[y]
        step = np.zeros_like(w)
        for _ in range(rounds):
            step = 0.9 * step - 0.3 * (x.T @ (self._softmax(x @ w) - want) / len(y) + l2 * w)
            w = w + step
        return w

    def probabilities(self, grams: Column) -> Column:
        """Array of class probabilities from the distinct n-grams of a paragraph."""
        flat = [x for g, i in self.place.items() for x in (F.lit(g), F.lit([float(v) for v in np.round(self.weights[i] * self.sharpness, 6)]))]
        table = F.create_map(*flat)
        start = F.lit([float(v) for v in np.round(self.weights[-1] * self.sharpness, 6)])
        z = F.aggregate(grams, start, lambda a, g: F.zip_with(a, table[g], lambda p, q: p + q))
        e = F.transform(z, lambda v: F.exp(v))
        return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def anchors(share: float = 0.6) -> list[str]:
    """Words of which every confirmed paragraph has at least one."""
    rare = lambda words: sorted(words, key=lambda w: (w in COMMON, -len(w), w))
    out = {rare(set(p.split()))[0] for x in PHRASES.values() for p in x}
    for t in (t for x in TEMPLATES.values() for t in x):
        words = rare(set(t.split()))
        least = next(m for m in range(len(words) + 1) if m / len(words) >= share)
        out.update(words[: len(words) - least + 1])
    return sorted(out)


def anchored(text: Column, share: float = 0.6) -> Column:
    return F.lower(text).rlike(f"(?<![a-z0-9])(?:{'|'.join(anchors(share))})(?![a-z0-9])")


def verdict(words: Column, model: Classifier) -> Column:
    """Family, probability and coverage of a paragraph's words; null where it is not confirmed."""
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    grams = F.array_intersect(F.concat(words, pairs), F.lit(sorted(model.place)))
    line = F.concat(F.lit(" "), F.concat_ws(" ", words), F.lit(" "))

    def coverage(family: str) -> Column:
        sets = [sorted(set(t.split())) for t in TEMPLATES[family]]
        whole = [F.when(line.contains(f" {x} "), model.share).otherwise(0.0) for x in PHRASES[family]]
        most = F.greatest(*(F.size(F.array_intersect(words, F.lit(s))) / len(s) for s in sets), F.lit(0.0))
        named = F.arrays_overlap(words, F.lit(KEYS[family])) if family in KEYS else F.lit(True)
        return F.greatest(F.when(named, most).otherwise(0.0), *whole)

    def judged(p: Column) -> Column:
        k = F.array_position(p, F.array_max(p)).cast("int")
        cases = F.lit(0.0)
        for i, family in enumerate(model.classes[1:], 2):
            cases = F.when(k == i, coverage(family)).otherwise(cases)
        return F.struct(F.element_at(F.lit(model.classes), k).alias("family"), F.array_max(p).alias("probability"), cases.alias("coverage"))

    likely = F.greatest(*(coverage(f) for f in model.classes[1:])) >= model.share
    found = F.when(likely, F.transform(F.array(model.probabilities(grams)), judged))
    return F.get(F.filter(found, lambda v: (v["probability"] >= model.least) & (v["coverage"] >= model.share)), F.lit(0))


def fit(seed: int = 9) -> Classifier:
    """Learns from the templates, their short forms and the sentences that are none. It is the same model
    wherever it is fitted: no text of a corpus, which nobody has labelled, takes part."""
    return Classifier(seed)


def licenses_of(text: Column, model: Classifier) -> Column:
    """Array of the licences of a text: first and last line (from 0), family, probability, coverage."""
    bare = lambda x: F.regexp_replace(x, r"(?i)^[^\p{L}\p{N}]*(?:dnl|rem)(?![\p{L}\p{N}])", "")
    known = F.lit(anchors(model.share))
    run = lambda c, i, j: F.slice(c, i + 1, j - i + 1)
    meets = lambda x, y: (y["line"] <= x["last"]) & (x["line"] <= y["last"])
    order = lambda x: F.struct((-x["v"]["coverage"]).alias("c"), (x["last"] - x["line"]).alias("n"), x["line"].alias("line"), x["last"].alias("last"), x["v"].alias("v"))
    goes_on = lambda y, x: (y["v"]["family"] == x["v"]["family"]) & (y["last"] + 1 == x["line"]) & (y["n"] + x["n"] > 0)

    def found(w: Column, blank: Column, anchor: Column) -> Column:
        words = lambda i, j: F.flatten(run(w, i, j))

        def runs(i: Column) -> Column:
            """Verdicts of the runs of lines that begin with line i."""
            reach = lambda j: (j <= i + 1) | (F.size(words(i + 1, F.greatest(i + 1, j - 1))) < REACH)
            fits = lambda j: ~F.exists(run(blank, i, j), lambda x: x) & F.exists(run(anchor, i, j), lambda x: x) & reach(j)
            ends = F.filter(F.sequence(i, F.least(i + REACH, F.size(w) - 1)), fits)
            return F.filter(F.transform(ends, lambda j: F.struct(i.alias("line"), j.alias("last"), once(words(i, j), lambda x: verdict(x, model)).alias("v"))), lambda x: x["v"].isNotNull())

        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.exists(run(anchor, i, F.least(i + REACH, F.size(w) - 1)), lambda x: x))
        return F.array_sort(F.transform(F.flatten(F.transform(starts, runs)), order))

    taken = lambda ranked: F.aggregate(ranked, F.slice(ranked, 1, 0), lambda a, x: F.when(F.exists(a, lambda y: meets(x, y)), a).otherwise(F.concat(a, F.array(x))))
    firsts = lambda chosen: F.filter(chosen, lambda x: ~F.exists(chosen, lambda y: goes_on(y, x)))
    told = lambda x: F.struct(x["line"].alias("line"), x["last"].alias("last"), x["v"]["family"].alias("family"), x["v"]["probability"].alias("probability"), x["v"]["coverage"].alias("coverage"))

    def scanned(lines: Column) -> Column:
        w, blank = F.transform(lines, words_of), F.transform(lines, lambda x: ~x.rlike(r"[\p{L}\p{N}]"))
        anchor = lambda w: F.transform(w, lambda x: F.arrays_overlap(x, known))
        ranked = once(w, lambda w: once(blank, lambda blank: once(anchor(w), lambda anchor: found(w, blank, anchor))))
        return F.array_sort(F.transform(once(once(ranked, taken), firsts), told))

    return F.when(anchored(text, model.share), once(F.transform(F.split(text, "\r\n|\r|\n"), bare), scanned))


def scan(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each licence: doc_id, first and last line (from 0), family, probability, coverage."""
    found = docs.select(F.col(doc_id).alias("doc_id"), licenses_of(F.col(text).cast("string"), model).alias("found"))
    return found.select("doc_id", F.inline("found"))


def per_document(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_licenses and families (sorted, distinct) of each row, by that row's text alone."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(licenses_of(F.col(text).cast("string"), model).getField("family"), F.array().cast("array<string>")).alias("found"))
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_sort(F.array_distinct("found")).alias("families"))
