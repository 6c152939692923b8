"""Classifiers against plain versions of the same models: strings, loops and dictionaries."""

import math
import re

import numpy as np
import pytest

pytest.importorskip("lakeloom.llm")

TEXTS = [None, "", "12 34!", "a", "Ab c", "The quick brown fox, jumped — over 13 lazy dogs.", "ÉCOLE d'été été ÉTÉ", "x" * 300, "日本語のテキスト and words", "Ωμέγα ΣΑΣ", "the fool is an idiot " * 5, "don't\nstop\tnow\x00or\x1flater"] + [f"word{i} some other words number {i * 7} and the end of line {'!' * (i % 3)}" for i in range(40)]


def letters_of(text):
    low = (text or "").lower()
    return " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in low)).strip(" ") + " " if any(c.isalpha() for c in low) else " "


def gram_hash(gram):
    h = 0
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
    m = (h ^ h >> 29) * 0xD6E8FEB86659FD93 % 2**64
    return m ^ m >> 32


def grams(text, orders):
    s = letters_of(text)
    return [gram_hash(s[i : i + n]) for n in orders for i in range(len(s) - n + 1)]


def test_toxicity_scores(spark):
    from lakeloom.llm import toxicity

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("fool" in (t or "") or i % 5 == 0)) for i, t in enumerate(TEXTS)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    assert len(weights) > 20
    for r in toxicity.score(docs, model).collect():
        z = model.intercept + sum(weights.get(h, 0.0) for h in set(grams(TEXTS[r.doc_id], range(3, 7))))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.5)


def test_toxicity_ratios():
    """Naive Bayes log-count ratios by counting strings."""
    from lakeloom.llm import toxicity

    toxic, clean = ["bad words here", "bad bad thing"], ["good words here", "nice thing", "plain"]
    r = toxicity.ratio(np.array([2.0, 0.0]), np.array([0.0, 2.0]), len(toxic), len(clean))
    assert np.allclose(r, [math.log(2.5 / 3) - math.log(0.5 / 4), math.log(0.5 / 3) - math.log(2.5 / 4)])


def test_language_scores(spark):
    from lakeloom.llm import language_id

    rows = [(i, t, ["en", "fr", "de"][i % 3]) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit(docs, clusters=2)
    assert len(m.languages) == 3 and len(m.vectors) > 3
    for r in language_id.identify(docs, m, ["doc_id"]).collect():
        if letters_of(TEXTS[r.doc_id]) == " ":
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        counts: dict = {}
        for h in grams(TEXTS[r.doc_id], range(1, 4)):
            counts[h % language_id.DIMS] = counts.get(h % language_id.DIMS, 0) + 1
        v = {k: math.log1p(n) * float(m.idf[k]) for k, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x / norm * float(c[k]) for k, x in v.items()) for c in m.vectors]
        best = [max(c for c, o in zip(cosines, m.owner) if o == k) for k in range(3)]
        assert abs(r.cosine - max(best)) < 1e-5 and abs(best[m.languages.index(r.lang_pred)] - max(best)) < 1e-5
        share = 1 / sum(math.exp(m.sharpness * (b - max(best))) for b in best)
        assert abs(r.score - share) < 1e-3
        band = min(int(math.log2(max(1, sum(counts.values())))), language_id.BANDS - 1)
        floor = m.floor[m.languages.index(r.lang_pred)][band]
        assert r.rejected == (r.cosine < floor) or abs(r.cosine - floor) < 1e-5


def words(line):
    return [w for w in re.split("[^a-z0-9]+", line.lower()) if w and not re.fullmatch("v?[0-9]+", w)]


def scanned(text, model):
    """Every run of lines judged by itself, without anchors; then the best covered, the shortest and the first."""
    from lakeloom.llm import licenses as L

    lines = [re.sub(r"(?i)^[\W_]*(?:dnl|rem)(?![^\W_])", "", x) for x in re.split("\r\n|\r|\n", text or "")]
    bags = [words(x) for x in lines]
    blank = [not any(c.isalnum() for c in x) for x in lines]
    found = []
    for i in range(len(lines)):
        for j in range(i, min(i + L.REACH, len(lines) - 1) + 1):
            if any(blank[i : j + 1]) or j > i + 1 and sum(map(len, bags[i + 1 : j])) >= L.REACH:
                continue
            w = [x for b in bags[i : j + 1] for x in b]
            line = " " + " ".join(w) + " "
            cover = {}
            for f in model.classes[1:]:
                named = f not in L.KEYS or any(k in w for k in L.KEYS[f])
                most = max(len(set(w) & set(t.split())) / len(set(t.split())) for t in L.TEMPLATES[f]) if named else 0.0
                cover[f] = max([most, *(model.share for p in L.PHRASES[f] if f" {p} " in line)])
            if max(cover.values()) < model.share:
                continue
            z = np.array(model.weights[-1] * model.sharpness)
            for g in {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}:
                if g in model.place:
                    z = z + model.weights[model.place[g]] * model.sharpness
            p = np.exp(z) / np.exp(z).sum()
            k = int(p.argmax())
            if k and p[k] >= model.least and cover[model.classes[k]] >= model.share:
                found.append((-cover[model.classes[k]], j - i, i, j, model.classes[k]))
    taken = []
    for x in sorted(found):
        if all(x[2] > y[3] or y[2] > x[3] for y in taken):
            taken.append(x)
    goes_on = lambda y, x: y[4] == x[4] and y[3] + 1 == x[2] and y[1] + x[1] > 0
    return sorted((x[2], x[3], x[4]) for x in taken if not any(goes_on(y, x) for y in taken))


def test_licenses(spark):
    from lakeloom.llm import licenses as L

    model, r = L.fit(), np.random.default_rng(8)
    parts = [t for x in (*L.TEMPLATES.values(), *L.PHRASES.values()) for t in x] + L.OTHERS
    rows = [(0, None), (1, ""), (2, "\n\n")]
    for i in range(60):
        out = []
        for _ in range(r.integers(1, 4)):
            w = [x for x in parts[r.integers(len(parts))].split() if r.random() > 0.08]
            cut = sorted(r.integers(0, len(w) + 1, r.integers(0, 3)).tolist())
            mark = ["", "# ", " * ", "// "][r.integers(4)]
            out += [mark + " ".join(w[a:b]) for a, b in zip([0, *cut], [*cut, len(w)])]
            out += ["", "plain words of a text", "# "][: r.integers(0, 4)]
        rows.append((10 + i, "\n".join(out)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got: dict = {i: [] for i, _ in rows}
    for x in L.scan(df, model).collect():
        got[x.doc_id].append((x.line, x.last, x.family))
    want = {i: scanned(t, model) for i, t in rows}
    assert {i: sorted(v) for i, v in got.items()} == want and sum(map(bool, want.values())) > 30


@pytest.mark.parametrize("name", ["op4_quality", "op6_jaccard_join"])
def test_sql(spark, name):
    import oracle
    from lakeloom.llm import queries

    folder = "/root/testdata/sf0.001"
    assert oracle.compare(spark, folder, queries.QUERIES[name], queries.ORACLES[name], oracle.connect(folder)) == ""
