"""Every registered query against its SQL on the smallest tables, and the parts that have none."""

import pytest

import oracle
from lakeloom import catalog
from lakeloom.functions import cells, formula
from lakeloom.operators import editing, ranges

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    assert oracle.compare(spark, FOLDER, catalog.QUERIES[name], catalog.ORACLES[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_formulas():
    book = {("S", 0, 0): 1.0, ("S", 1, 0): 2.0, ("S", 2, 0): "x", ("S", 3, 0): "3", ("T 1", 0, 0): 5.0}
    sources = {
        "=SUM(A1:A4)+'T 1'!A1": 8.0, "=2^2^3": 64.0, '=IF(A1<2,"a"&A2,0)': "a2", "=ROUND(-2.5,0)": -2.0, "=ROUND(-1.5,0)": -2.0, '=TEXT(1234.565,"#,##0.00")': "1,234.57",
        "=VLOOKUP(2,A1:A4,1)": 2.0, '=COUNTIF(A1:A4,">1")': 1.0, "=50%+1/0": "#DIV/0!", '=VALUE("(1,234)")': -1234.0, "=SUM(\"3\",TRUE)": 4.0, "=MID(\"abc\",0,1)": "#VALUE!", "=MOD(7,-3)": -2.0,
        "=AVERAGE(A3)": "#DIV/0!", "=Nope!A1": "#REF!", "=A1&TRUE": "1TRUE", "=COUNTA(A1:A9)": 4.0, "=RIGHT(\"abc\",2)": "bc", "=-A3": "#VALUE!", '=SUMIF(A1:A2,">1")': 2.0,
    }
    places = {("S", i, 1): s for i, s in enumerate(sources)}
    done = formula.recalculate(book, places, ["S", "T 1"])
    assert {s: done[p][0] for p, s in places.items()} == sources


def test_cycles_and_unknown_functions():
    done = formula.recalculate({("S", 2, 0): 7.0}, {("S", 0, 0): "=A2", ("S", 1, 0): "=A1", ("S", 2, 0): "=FOO(1)", ("S", 3, 0): "=A3+1", ("S", 4, 0): "=SUM(A:A)"}, ["S"])
    assert done[("S", 0, 0)] == ("#CIRC!", "error") and done[("S", 2, 0)] == (7.0, "unsupported:FOO") and done[("S", 3, 0)] == (8.0, "ok")
    assert done[("S", 4, 0)][1].startswith("unsupported")


def test_long_chain():
    n = 5000
    done = formula.recalculate({("S", 0, 0): 1.0}, {("S", i, 0): f"=A{i}+1" for i in range(1, n)}, ["S"])
    assert done[("S", n - 1, 0)] == (float(n), "ok")


def test_number_formats(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1234567.891,), (-0.5,), (5.0,), (0.125,)], "x double")
    got = df.select(cells.format_number(F.col("x"), "#,##0.00").alias("a"), cells.format_number(F.col("x"), "0%").alias("b"), cells.format_number(F.col("x"), "000").alias("c")).collect()
    assert [tuple(r) for r in got] == [("1,234,567.89", "123456789%", "1234568"), ("-0.50", "-50%", "-1"), ("5.00", "500%", "5"), ("0.13", "13%", "0")]


def test_range_windows_cover_texts(spark):
    df = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, "abc")], "k int, t string")
    rows = ranges.windows(df, "k", "t", 3).orderBy("k", "start").collect()
    assert [(r.k, r.content, r.next_start) for r in rows] == [(1, "abc", 3), (1, "def", 6), (1, "g", None), (2, "", None), (3, "abc", None)]


def test_approximate_lookup_at_size(spark):
    """Many partitions, small ones put together, a hot key, and lookup keys in no order."""
    import numpy as np

    from lakeloom.operators import sheetops

    r = np.random.default_rng(5)
    keys, wanted = r.integers(0, 90_000, 30_000), np.where(r.random(400_000) < 0.3, 7, r.integers(-50, 100_000, 400_000))
    wanted[0] = -60
    facts = spark.createDataFrame(list(zip(range(len(wanted)), map(float, wanted))), "i long, x double").repartition(64).union(spark.createDataFrame([(-1, None), (-2, float("nan"))], "i long, x double"))
    lookup = spark.createDataFrame(list(zip(range(len(keys)), map(float, keys))), "row long, k double")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        got = {x.i: x.found for x in sheetops.vlookup_approximate(facts, "x", lookup, "k", "row", "row", "found").select("i", "found").collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    order = np.lexsort((np.arange(len(keys)), keys))
    best, first = np.maximum.accumulate(order), {}
    for i, k in enumerate(keys.tolist()):
        first.setdefault(k, i)
    at = np.searchsorted(keys[order], wanted, "left") - 1
    want = {i: first.get(x, int(best[at[i]]) if at[i] >= 0 else None) for i, x in enumerate(wanted.tolist())}
    assert got == want | {-1: None, -2: None}


def test_text_counters(spark):
    """The one pass against the regular expressions that define the classes."""
    import re

    from lakeloom.functions import textstats as stats

    r = __import__("random").Random(3)
    letters = "aAbBzéÃ \n\t\r.…数\uff01\ue0a1\ufffd\x01\x7f\x85Ωж│■😀0_-\ufffe"
    texts = ["", ".", "..", "...", "bcdfghjk", "abcdef", "\n", "😀" * 3] + ["".join(r.choices(letters, weights=None, k=r.randrange(200))) + r.choice(["", "bcdfghjklm" * 3, "....", "letters"]) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {x.i: x for x in stats.counted(df, "t", "i", piece=500).collect()}
    spec = {k: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\U{int(m[1], 16):08X}", v) for k, v in stats.CLASSES.items()}
    total = lambda pattern, t: sum(map(len, re.findall(pattern, t)))
    for i, t in enumerate([*texts, ""]):
        assert got[i].visible == len(re.sub(r"[ \t\n\r]+", "", re.sub(r"\.{3,}", "", t))), t
        assert all(got[i][k] == len(re.findall(f"[{v}]", t)) for k, v in spec.items()), t
        assert got[i].letter_runs == total("[A-Za-z]{6,}", t) and got[i].no_vowel == total(f"[{stats.CONSONANT}]{{8,}}", t)


def test_transcripts():
    from lakeloom.operators.recognition import cleaned

    same = ["Sure enough, revenue rose in 2024", "here is a line", "Here's the plan for today", "以下为具体安排：\n第一条", "a\n\nb", "图片", ""]
    assert [cleaned(x) for x in same] == same
    assert cleaned("Transcription:\r\nbody\r\nUncertain: end cut") == "body"
    assert cleaned("body first\nTranscription:\nmore") == "body first\nmore"
    assert cleaned("该图片为扫描件\n正文一\n图中是表格。\n\n原文：\n正文二") == "正文一\n\n正文二"
    assert cleaned("```text\nx\n```") == "x" and cleaned(None) == ""


def test_sheet_guards(spark):
    one = spark.createDataFrame([(0, "A")], "pos long, sheet string")
    with pytest.raises(ValueError):
        editing.delete_sheet(one, "A")
    with pytest.raises(ValueError):
        editing.rename_sheet(one, "B", "C")


def test_blocks_after_edits(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([("paragraph", "x"), ("paragraph", "y")],)], "b array<struct<type:string,text:string>>")
    new = F.struct(F.lit("image").alias("type"), F.lit("i").alias("text"))
    a, found = editing.insert_after(F.col("b"), "x", new)
    z, missed = editing.insert_after(F.col("b"), "q", new)
    r = df.select(a.alias("a"), found.alias("f"), z.alias("z"), missed.alias("m")).first()
    assert [x.text for x in r.a] == ["x", "i", "y"] and r.f and [x.text for x in r.z] == ["x", "y", "i"] and not r.m


@pytest.mark.parametrize("name", ["formula_recalc", "formula_census"])
def test_recalculation_with_joins_by_sorting(spark, con, name):
    """Workbooks stay whole where large tables are joined by sorting, as by default they are from 10 MB on: the
    rows are dealt by workbook after all joins, which may be planned anew."""
    large = {"spark.sql.autoBroadcastJoinThreshold": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in large.items():
        spark.conf.set(k, v)
    try:
        plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan.partition("MapInArrow")[2].partition("Union")[0]
        assert oracle.compare(spark, FOLDER, catalog.QUERIES[name], catalog.ORACLES[name], con) == ""
    finally:
        for k in large:
            spark.conf.unset(k)


def test_recalculation_reads_cells_once(spark):
    """No join and one shuffle; workbooks that span batches, one too large between others, places without row."""
    from lakeloom.operators import recalc

    schema = "book string, sheet string, row int, col int, v string, t string, f string"
    books = {"a": 3, "b": 40, "c": 5}
    rows = [(b, "S", i, 0, str(i), "n", None) for b, n in books.items() for i in range(n)] + [(b, "S", i, 1, "9", "n", f"=SUM(A1:A{i + 1})*2") for b in books for i in range(2)]
    rows += [(b, "T", 0, 0, "7", "n", f) for b, f in (("a", "=SUM(S!A1:B99)"), ("b", "=1"), ("c", "=SUM(S!A:A)"))] + [("c", None, None, 0, "x", "s", "=COUNT(S!A1:Z1000)"), (None, "S", 0, 0, "1", "n", "=A1")]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        done = recalc.recalculate(spark.createDataFrame(rows, schema), most=10)
        plan = done._jdf.queryExecution().executedPlan().toString()
        got = {(r.book, r.sheet, r.row, r.col): (r.v, r.state) for r in done.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert got[("a", "S", 0, 1)] == ("0", "ok") and got[("a", "S", 1, 1)] == ("2", "ok") and got[("a", "T", 0, 0)] == ("5", "ok")
    assert [got[("b", s, i, c)] for s, i, c in (("S", 0, 1), ("S", 1, 1), ("T", 0, 0))] == [("9", "skipped"), ("9", "skipped"), ("7", "skipped")]
    assert got[("c", "S", 1, 1)] == ("2", "ok") and got[("c", "T", 0, 0)][0] == "7" and got[("c", "T", 0, 0)][1].startswith("unsupported") and len(got) == 11
