"""One table of odd rows through every operator and stage: null and repeated ids, null, empty and very long
texts, ties, columns with the operators' own names, and the empty table."""

import hashlib
import zlib
from array import array

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, __t string, __words string, part int, label int, set string, judged string, kept string, n_words int, score string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(r.integers(0, 50)) for i in r.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def rows():
    long = prose(1, 700_000)
    assert len(long) > 5_000_000
    found = [(None, prose(2, 60)), (None, prose(2, 60)), (7, prose(3, 80)), (7, prose(3, 80)), (7, prose(4, 80)), (8, None), (9, ""), (10, " \n\t "), (11, long), (12, prose(2, 60)), (13, "Released under the MIT License."), (None, "Released under the MIT License."), (14, "\x00\x1f ﻿ \U0001f600"), (None, None)]
    return found + [(100 + i, prose(100 + i, 40)) for i in range(20)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = ("a", "b", 3, 4, "s", "j", "k", 5, "x")
    return spark.createDataFrame([(i, t, "en" if k % 3 else None, "s", 1, *clash) for k, (i, t) in enumerate(rows)], COLUMNS)


def texts(rows):
    return sorted((i is not None, i or 0, t or "") for i, t in rows)


def ids_of(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def as_bytes(ids) -> bytes:
    return array("I", ids).tobytes()


def test_token_counts(docs, rows):
    from lakeloom.llm.token_counts import token_counts

    ids = ids_of("byte_bpe_50k.json")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts(docs, P.path("byte_bpe_50k.json")).collect())
    assert got == sorted((i is not None, i or 0, len((t or "").encode()), len(ids(t))) for i, t in rows)


def test_byte_bpe(docs, rows):
    from lakeloom.llm.byte_bpe import round_trip

    got = sorted((r.doc_id is not None, r.doc_id or 0, r.decoded_sha256) for r in round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect())
    assert got == sorted((i is not None, i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_toxicity(spark, docs, rows):
    from lakeloom.llm import toxicity

    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(20)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(r.held_out is not None and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    same = [r.score for r in got if r.doc_id in (8, 9, 10)]
    assert len(set(same)) == 1


def test_quality(docs, rows):
    from lakeloom.llm.quality import judge

    judged = judge(docs)
    got = judged.collect()
    assert len(got) == len(rows) and judged.columns.count("kept") == 1 and {"__t", "__words", "part", "judged"} <= set(judged.columns)
    assert all((r.n_words, r.kept, r.base_failed) == (0, False, True) for r in got if r.doc_id in (8, 9, 10))
    long = next(r for r in got if r.doc_id == 11)
    assert long.n_words == 700_000 and judged.where("kept").count() == sum(r.kept for r in got) > 20


def test_token_files(spark, docs, rows, tmp_path):
    from lakeloom.llm import token_files

    ids, at, want = ids_of("byte_bpe_50k.json"), 0, []
    for known, i, t in texts(rows):
        whole = as_bytes([*ids(t), 0])
        want.append((i if known else None, at, len(whole) // 4, zlib.crc32(whole)))
        at += len(whole) // 4
    token_files.write(docs, P.path("byte_bpe_50k.json"), str(tmp_path / "f"))
    got = [tuple(r) for r in token_files.read(spark, str(tmp_path / "f")).orderBy("start").collect()]
    assert got == want and any(n > 10 * 16_384 for _, _, n, _ in got)


@pytest.mark.parametrize("counted", [True, False])
def test_jaccard_join(docs, rows, counted):
    from lakeloom.llm.jaccard_join import near_duplicates

    got = near_duplicates(docs, count_links=counted).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(r.component_id is None and r.class_id is None for r in got if r.doc_id is None)
    assert {of[i].component_id for i in (8, 9, 10)} == {8, 9, 10} and of[8].n_shingles == 0 and of[12].component_id == 12
    assert {r.component_id for r in got if r.doc_id == 7} == {7} and of[11].component_id == 11 and of[11].n_shingles > 690_000


def test_licenses(docs, rows):
    from lakeloom.llm import licenses

    got = licenses.per_document(docs, licenses.fit()).collect()
    assert len(got) == len(rows) and sorted((r.doc_id is not None, r.doc_id or 0) for r in got if r.n_licenses) == [(False, 0), (True, 13)]
    assert all(list(r.families) == ["mit"] for r in got if r.n_licenses)
    assert licenses.per_document(docs.limit(0), licenses.fit()).count() == 0


def test_language(docs, rows):
    from lakeloom.llm import language_id

    model = language_id.fit(docs)
    got = language_id.identify(docs, model, ["doc_id", "__t", "score", "set"]).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"en", "und"}
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in got if r.doc_id in (8, 9, 10, 14))
    none = language_id.fit(docs.where("doc_id IN (8, 9, 10)"))  # no letter to learn from
    assert {r.lang_pred for r in language_id.identify(docs, none, ["doc_id"]).collect()} == {"und"}


def test_packing(docs, rows):
    from lakeloom.llm.packing import pack

    ids = ids_of("word_bpe_49k.json")
    got = pack(docs, P.path("word_bpe_49k.json")).collect()
    want = []
    for i, t in rows:
        whole = [*ids(t), 0]
        want += [(i is not None, i or 0, at // 2048, at, zlib.crc32(as_bytes(whole[at : at + 2048]))) for at in range(0, len(whole), 2048)]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.ids_crc32) for r in got) == sorted(want)
    room: dict = {}
    for r in got:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(at == sum(n for _, n in sorted(x)[:k]) for x in room.values() for k, (at, _) in enumerate(sorted(x)))


def test_neighbours(spark):
    from lakeloom.llm.neighbours import nearest

    r = np.random.default_rng(3)
    m = r.normal(size=(120, 8))
    rows = [(i, [float(x) for x in v], "x", 1) for i, v in enumerate(m)] + [(0, [float(x) for x in m[5]], "x", 1)] * 3 + [(40, [float(x) for x in m[7]], "y", 2), (None, [1.0] * 8, "z", 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string, chunk int")
    got: dict = {}
    for x in nearest(df, every=20, k=10).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
    assert set(got) == {0, 20, 40, 60, 80, 100} and all(sorted(v) == list(range(1, 11)) for v in got.values())
    q = min(m[0].tolist(), m[5].tolist())  # the least vector of a repeated id
    best = sorted(((float(np.dot(v, q)), -i) for i, v in enumerate(m) if i), reverse=True)[:10]
    assert all(abs(got[0][k][1] - s) < 1e-9 for k, (s, _) in enumerate(best, 1))
    assert all(0 not in {i for i, _ in v.values()} or q != 0 for q, v in got.items())


def test_stages(spark, docs, rows):
    import corpus_pipeline as C

    table = docs.select("doc_id", "text", "lang", "source", "n_chars", "set", "kept")
    spoken = C.identify_language(spark, table, "")
    assert spoken.columns == table.columns and spoken.where("doc_id IN (8, 9, 10, 14)").count() == 0
    good = C.apply_quality_rules(spark, table, "")
    assert good.columns == table.columns and {r.doc_id for r in good.collect()} >= {7, 11, 12, 100, None}
    left = C.drop_near_duplicates(spark, table, "")
    assert left.columns == table.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    assert sum(i is None for i, _ in kept) == 4 and [t for i, t in kept if i == 7] == [min(prose(3, 80), prose(4, 80))]
    assert {i for i, _ in kept} == {i for i, _ in rows}
    for stage in (C.identify_language, C.apply_quality_rules, C.drop_near_duplicates):
        assert stage(spark, table.limit(0), "").count() == 0
    assert C.pack_sequences(spark, table.limit(0), "").count() == 0


def test_pipeline_of_an_empty_table(spark, docs, tmp_path):
    import corpus_pipeline as C

    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
