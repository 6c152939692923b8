"""Training-data operators against brute force and the public libraries, odd rows included."""

import array
import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(r.integers(0, 60)) for i in r.integers(0, len(WORDS), n))


def written(spark) -> int:
    """Rows that shuffles have written so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 120)
    passage = prose(9, 60)
    out = [None, "", " ", "\n\n \t", "one", "two words", base, base, base.replace("alpha", "ALPHA"), base + " tail", base.replace(" ", "  ", 3), "a" * 5000, ("x y " * 800).strip(), "don't <|endoftext|> ÉCOLE é 日本語\x1c 😀 \r\n ok", "Released under the MIT License.\nbody text here"]
    out += [prose(100 + i, 90) for i in range(12)] + [passage + " " + prose(200 + i, 40) for i in range(12)]
    near = prose(5, 150).split(" ")
    for i in range(14):
        w = list(near)
        w[10 * i] = f"changed{i}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Extra columns have the names of results."""
    rows = [(i, t, ["en", "de"][i % 2], "s", 0, 0.5, True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(array.array("I", ids).tobytes())


def test_spans_equal_library(texts):
    from lakeloom.llm.spans import SpanEncoder, SpanTable, library_encoder

    odd = [t or "" for t in texts] + ["  a", "a  b\n\nc", " \n x", "x\n", "\n", "a\t b", "'S don'T İx ΣΑΣ"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        ids, encoder = library(name), SpanEncoder(library_encoder(P.path(name), "ids"), room=3)
        want = [ids(t) for t in odd]
        assert [b"".join(x) for x in encoder.all(odd, chars=50)] == [array.array("I", x).tobytes() for x in want]
        for room, chars in ((3, 50), (1000, 10_000_000)):
            table = SpanTable(SpanEncoder(library_encoder(P.path(name), "ids"), room), ids=True)
            for _ in range(2):
                got = list(table.batches(odd, chars))
                assert np.concatenate([c for _, c, _ in got]).tolist() == list(map(len, want))
                assert np.concatenate([f for _, _, f in got]).tolist() == [i for x in want for i in x]
            counts = SpanTable(SpanEncoder(library_encoder(P.path(name), "lengths"), room, {}), ids=False)
            assert [n for _, c, _ in counts.batches(odd, chars) for n in c.tolist()] == list(map(len, want))


def test_token_counts(docs, texts):
    from lakeloom.llm.token_counts import token_counts

    ids = library("byte_bpe_50k.json")
    got = {r.doc_id: r for r in token_counts(docs, P.path("byte_bpe_50k.json"), limit=100).collect()}
    for i, t in enumerate(texts):
        n = len(ids(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100)
    assert token_counts(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_byte_bpe(docs, texts):
    import tiktoken

    from lakeloom.llm import byte_bpe

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, path, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    both = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in both.collect()} == {i: t or "" for i, t in enumerate(texts)}


def measured(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeat = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeat)


def test_quality(docs, texts):
    from lakeloom.llm.quality import judge

    got = {r.doc_id: r for r in judge(docs).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], measured(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert got[15].kept and judge(docs.limit(0)).count() == 0


def linked(texts):
    sets = []
    for t in texts:
        w = tuple((t or "").encode().lower().split())
        sets.append({w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize("small", [200, 2])
def test_jaccard_join(docs, texts, small, monkeypatch):
    from lakeloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "CHUNK", 4)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    sizes, label = linked(texts)
    assert [got[i] for i in range(len(texts))] == list(zip(sizes, label))


def test_jaccard_join_of_a_digest(spark, monkeypatch):
    """A text of hundreds of others shares shingles with all of them, and a cell with none."""
    from lakeloom.llm import jaccard_join

    short = [prose(3000 + i, 30) for i in range(300)]
    rows = list(enumerate([*short, " ".join(short), " ".join(short[:290]), *(x + " end" for x in short[:20])]))
    seen, cells = [], jaccard_join.cells
    monkeypatch.setattr(jaccard_join, "cells", lambda *a: seen.append(cells(*a)) or seen[0])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.near_duplicates(df, count_links=True).collect()}
    _, label = linked([t for _, t in rows])
    assert [got[i][0] for i, _ in rows] == label and got[300] == (300, 1) == got[301] and got[302] == (0, 1)
    assert {r.doc for r in seen[0].collect()} == {*range(20), *range(300, 322)}


def test_jaccard_join_empty(docs):
    from lakeloom.llm.jaccard_join import near_duplicates

    assert near_duplicates(docs.limit(0)).count() == 0


def test_licenses(docs, texts):
    from lakeloom.llm import licenses

    model = licenses.fit()
    got = {r.doc_id: list(r.families) for r in licenses.per_document(docs, model).collect()}
    assert {i for i, f in got.items() if f} == {14} and got[14] == ["mit"] and len(got) == len(texts)


def test_wrapped_licenses(spark):
    import textwrap

    from lakeloom.llm import licenses

    heads = {
        "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",
        "apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "gpl": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "unlicense": "This is free and unencumbered software released into the public domain.",
    }
    spdx = dict(zip(heads, "AGPL-3.0-only Apache-2.0 BSD-3-Clause CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 GPL-2.0-or-later LGPL-2.1-only MIT MPL-2.0 Unlicense".split()))
    rows, want = [], {}
    for family, head in heads.items():
        for width in (20, 40, 70):
            for mark in ("", "# ", " * ", "dnl "):
                text = f"{prose(7, 30)}\n{mark}\n" + "\n".join(mark + x for x in textwrap.wrap(head, width)) + f"\n{mark}\n{prose(8, 30)}"
                rows.append((len(rows), text))
                want[len(rows) - 1] = [family]
        rows.append((len(rows), f"// SPDX-License-Identifier: {spdx[family]}\n{prose(3, 20)}"))
        want[len(rows) - 1] = [family]
    plain = ["SPDX-License-Identifier: ISC", "He was released\nunder the law of the city\nand the source of the terms is public", "Redistribution and use in source\n\n\nwas binary", "the driver needs\na license to drive"]
    both = textwrap.fill(heads["bsd"], 50) + "\nReleased under the MIT License.\nReleased under the MIT License."
    rows += [(1000 + i, t) for i, t in enumerate([*plain, both])]
    want |= {1000 + i: [] for i in range(len(plain))} | {1000 + len(plain): ["bsd", "mit"]}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.per_document(df, licenses.fit()).collect()}
    assert {i: list(r.families) for i, r in got.items()} == want
    assert got[1000 + len(plain)].n_licenses == 3 and all(got[i].n_licenses == 1 for i in want if i < 1000)


def test_license_anchors_lose_nothing():
    from lakeloom.llm import licenses

    known = set(licenses.anchors())
    for t in (t for x in licenses.TEMPLATES.values() for t in x):
        rest = set(t.split()) - known
        assert len(rest) / len(set(t.split())) < 0.6
    assert all(set(p.split()) & known for x in licenses.PHRASES.values() for p in x)


def test_language(spark, docs):
    from lakeloom.llm import language_id

    r = np.random.default_rng(4)
    said = {"xx": "the quick brown fox jumps over lazy dogs".split(), "yy": "złoty kot biegnie szybko przez ciemny las".split()}
    rows = [(i, " ".join(r.choice(said[k], 30)), k) for i in range(200) for k in [["xx", "yy"][i % 2]]] + [(900, None, "xx"), (901, "12 34", None), (902, "кириллица", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.identify(df, language_id.fit(df), ["doc_id"]).collect()}
    assert all(got[i].lang_pred == k and not got[i].rejected for i, _, k in rows[:200])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[902].rejected
    none = language_id.identify(df.limit(0), language_id.fit(df.limit(0)), ["doc_id"])
    assert none.count() == 0


def test_language_rejects_gibberish(spark):
    from lakeloom.llm import language_id

    r = np.random.default_rng(6)
    said = {"en": "the and that of with there which have from they been other would could about their when more these through", "fr": "les des une dans pour avec nous vous leur cette mais comme être tout aussi entre après même ainsi plus"}
    rows = [(i, " ".join(r.choice(said[k].split(), 20 + i % 300)), k) for i in range(1200) for k in [["en", "fr"][i % 2]]]
    odd = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz     "), n)) for n in (1500, 9000)]
    odd += [" ".join(r.choice("tämä talo kuin mutta hän oli myös sitten koska vielä jälkeen kaikki".split(), n)) for n in (60, 300)]
    df = spark.createDataFrame(rows + [(9000 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.identify(df, language_id.fit(df), ["doc_id"]).collect()}
    assert all(got[9000 + i].rejected for i in range(len(odd)))
    assert all(got[i].lang_pred == k and not got[i].rejected for i, _, k in rows)


def test_toxicity(spark):
    from lakeloom.llm import toxicity

    r = np.random.default_rng(2)
    rows = [(i, prose(i, 40) + (" horrible" + "idiot" if i % 3 == 0 else "") + " " + prose(i + 1000, 20)) for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(300)) and len(held) > 20
    assert np.mean([got[i].predicted == int(i % 3 == 0) for i in held]) > 0.95
    assert got[900].score == got[901].score < 0.5 and r is not None
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).first().score == 0


def test_neighbours(spark):
    from lakeloom.llm.neighbours import nearest

    r = np.random.default_rng(7)
    m = r.normal(size=(1500, 16)) + 4 * r.normal(size=(10, 16))[r.integers(0, 10, 1500)]
    m[100:160] = m[100]
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, [1.0])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + bad, "vec_id long, embedding array<double>")
    got: dict = {}
    for x in nearest(df, leaf_rows=64, chunk_rows=50, floor_rows=200, calibration=30).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
    hits = 0
    for q in range(0, 1500, 20):
        p = (m * m[q]).sum(axis=1)
        p[q] = -np.inf
        best = np.lexsort((np.arange(1500), -p))[:20]
        found = [got[q][k] for k in range(1, 21)]
        assert all(abs(p[i] - s) < 1e-9 for i, s in found) and found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in found} & set(best.tolist()))
    assert hits / (20 * 75) >= 0.9
    assert nearest(df.limit(0)).count() == 0
    few = {x.query_id for x in nearest(df.where("vec_id < 3")).collect()}
    assert few == {0}


def test_token_counts_do_not_depend_on_the_sample(spark):
    from tokenizers import Tokenizer

    from lakeloom.llm.token_counts import token_counts

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    for texts in ([None, "", "all words differ here"], [prose(i, 50) for i in range(40)]):  # the first sample has no frequent span
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for sizes in ({}, {"table_size": 0}, {"sample_rows": 1, "table_size": 3}):
            assert {r.doc_id: r.n_tokens for r in token_counts(df, path, **sizes).collect()} == {i: count(t) for i, t in enumerate(texts)}


def test_cells_shuffle_prefixes_once(spark, monkeypatch):
    from lakeloom.llm import jaccard_join as J
    from lakeloom.llm.shingles import prefix_length, shingles

    monkeypatch.setattr(J, "frequent", lambda sets, n: np.zeros(0, np.uint64))  # its sample has a shuffle of its own
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)  # as on tables with more shared shingles than a join may broadcast
    texts = [prose(i, 600) + end for i in range(100) for end in ("", " one other end")]
    sets = [shingles(t) for t in texts]
    df = J.materialise(spark.createDataFrame([(i, s.tobytes(), len(s)) for i, s in enumerate(sets)], "doc long, full binary, n long"), "sets")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = written(spark)
        found = {(r.region, r.doc) for r in J.cells(df, 200, 80).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert found == {(i - i % 2, i) for i in range(200)}
    assert written(spark) - before < 1.5 * sum(prefix_length(len(s), 80) for s in sets)


def test_neighbours_copies_no_vectors_to_leaves(spark):
    from lakeloom.llm.neighbours import nearest

    m = np.random.default_rng(8).normal(size=(10_000, 16))
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))  # alike in all directions, so that most leaves are visited
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")

    before = written(spark)
    got: dict = {}
    for x in nearest(df, leaf_rows=8, floor_rows=500).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    assert written(spark) - before < 250_000  # a row for each of 500 queries at each of its leaves was more
    best = {q: set(np.argsort(-(m @ m[q]))[1:21].tolist()) for q in range(0, 10_000, 20)}  # of unit vectors, the nearest is itself
    assert sum(len(got[q] & best[q]) for q in best) / (20 * 500) >= 0.9


def test_best_fit_equals_one_by_one():
    from lakeloom.llm.packing import best_fit

    r = np.random.default_rng(1)
    for _ in range(40):
        cap, lengths = 50, r.integers(1, 51, r.integers(0, 200)).tolist()
        open_: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = [c for c in open_ if c >= n]
            if fit:
                open_.remove(min(fit))
            open_.append((min(fit) if fit else cap) - n)
        bins: dict = {}
        for n, _, pieces, each, first, at in best_fit(Counter(lengths), cap):
            for k in range(pieces):
                bins.setdefault(first + k // each, []).append((at + k % each * n, n))
        for b in bins.values():
            b.sort()
            assert all(o == sum(n for _, n in b[:i]) for i, (o, _) in enumerate(b))
        assert sorted(cap - sum(n for _, n in b) for b in bins.values()) == sorted(open_)


def test_packing(docs, texts):
    from lakeloom.llm.packing import pack

    ids = library("word_bpe_49k.json")
    rows = pack(docs, P.path("word_bpe_49k.json"), capacity=64).collect()
    for i, t in enumerate(texts):
        whole = ids(t) + [0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [(s, len(whole[s : s + 64]), crc(whole[s : s + 64])) for s in range(0, len(whole), 64)]
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_token_files(spark, docs, texts, tmp_path):
    from lakeloom.llm import token_files

    ids, at = library("byte_bpe_50k.json"), 0
    token_files.write(docs, P.path("byte_bpe_50k.json"), str(tmp_path / "f"), block_ids=256)
    got = {r.doc_id: r for r in token_files.read(spark, str(tmp_path / "f")).collect()}
    for i, t in enumerate(texts):
        whole = ids(t) + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(whole), crc(whole))
        at += len(whole)
    token_files.write(docs.limit(0), P.path("byte_bpe_50k.json"), str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_blocks_round_trip_and_refuse_damage(spark):
    from pyspark.sql import functions as F

    from lakeloom.llm import token_blocks as B

    B.install(spark)
    r = np.random.default_rng(3)
    raw = [(r.zipf(1.3, n) % top).astype("<u4").tobytes() for n in (0, 1, 9, 3000, B.MOST) for top in (2, 900, 70_000, 2**31 - 1)]
    df = spark.createDataFrame([(bytearray(x),) for x in raw], "raw binary")
    coded = df.select("raw", B.encode(F.col("raw"), F.lit(1), F.lit(0)).alias("data"))
    rows = coded.select("raw", "data", B.decode(F.col("data")).alias("back")).collect()
    assert all(x.raw == x.back for x in rows) and sum(len(x.data) for x in rows) < sum(map(len, raw))
    block = bytearray(max((x.data for x in rows), key=len))
    for damaged in (block[:-3], block[: len(block) // 2] + bytearray([block[len(block) // 2] ^ 1]) + block[len(block) // 2 + 1 :], b"LTB1"):
        with pytest.raises(Exception, match="damaged|not a block"):
            spark.createDataFrame([(bytearray(damaged),)], "data binary").select(B.decode(F.col("data"))).collect()
    with pytest.raises(Exception, match="no place"):
        spark.createDataFrame([(bytearray(b"\xff" * 4),)], "raw binary").select(B.encode(F.col("raw"), F.lit(1), F.lit(0))).collect()


def test_joined_spans_equal_library_by_few_calls(texts, monkeypatch):
    """Distinct spans go to the engine together, and only what may not be joined goes alone."""
    import pyarrow as pa

    from lakeloom.llm.spans import JoinedSpans, SpanEncoder, library_encoder

    odd = texts + ["  a", "a  b\n\nc", " \n x", "x\n", "\n", "a\t b", "a\tb c\td", "'S don'T İx ΣΑΣ", "\nfoo\nbar\n foo", "\u3000a b\u00a0c d\u2003 e", "x<|endoftext|>y <|endoftext|>", "\tq r", "e\x1cf \x85g"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        ids = library(name)
        want = [ids(t) for t in odd]
        for size in (1, 300, 10_000_000):
            joiner, got = JoinedSpans(SpanEncoder(library_encoder(P.path(name), "ids"), 1000)), []
            for first, counts, flat in joiner.texts(pa.array(["cut off", *odd]).slice(1), size):
                assert first == len(got) and counts.sum() == len(flat)
                got += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
            assert got == want
            assert list(joiner.texts(pa.array([], pa.string()), size)) == []
    joiner, calls = JoinedSpans(SpanEncoder(library_encoder(P.path("byte_bpe_50k.json"), "ids"), 1000)), []
    engine = joiner.engine
    monkeypatch.setattr(joiner, "engine", type("Counted", (), {"encode_ordinary": lambda _, t: calls.append(t) or engine.encode_ordinary(t)})())
    alone = joiner.encoder.encode
    monkeypatch.setattr(joiner.encoder, "encode", lambda spans: calls.extend(spans) or alone(spans))
    many = [f"head {prose(i, 200)}\nline {i}" for i in range(50)]
    ((_, counts, flat),) = joiner.texts(pa.array(many))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [library("byte_bpe_50k.json")(t) for t in many]
    assert len(calls) <= 3


def test_blocks_learn_successors(spark):
    """Each id is followed by one of eight: 5.1 bits with what each takes to learn; bit by bit it took 7.5."""
    from pyspark.sql import functions as F

    from lakeloom.llm import token_blocks as B

    B.install(spark)
    r = np.random.default_rng(8)
    after, ids = r.permutation(50_000)[r.integers(0, 500, (50_000, 8))], [0]
    while len(ids) < B.MOST:
        ids.append(int(after[ids[-1], r.integers(0, 8)]))
    raw = [np.array(x, "<u4").tobytes() for x in (ids, r.permutation(70_000)[: B.MOST], [7] * B.MOST, np.arange(B.MOST))]
    df = spark.createDataFrame([(bytearray(x),) for x in raw], "raw binary").select("raw", B.encode(F.col("raw"), F.lit(1), F.lit(0)).alias("data"))
    rows = df.select("raw", "data", B.decode(F.col("data")).alias("back")).collect()
    assert all(x.raw == x.back for x in rows)
    sizes = {bytes(x.raw): 8 * len(x.data) / B.MOST for x in rows}
    assert sizes[raw[0]] < 6 and sizes[raw[1]] < 18 and sizes[raw[2]] < 0.1


def test_pipeline(spark, docs, texts, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    _, label = linked(texts)
    kept = {r.doc_id for r in packed}
    assert kept and all(label[i] == i or not measured(texts[label[i]])[0] for i in kept)
    assert all(measured(texts[i])[0] >= 10 for i in kept)
