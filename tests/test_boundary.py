"""What enters and leaves: published files, values for JSON, caps, page choices, memos and sweeps."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import sanitize
from lakeloom.operators import caches, convert, editing, ranges, recognition


def test_publish(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [("a/b.txt", bytearray(b"one")), ("c.txt", bytearray(b"")), ("../evil.txt", bytearray(b"x")), ("/abs.txt", bytearray(b"x")), ("none.txt", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (r.size, r.error) for r in convert.publish(df, folder).collect()}
    assert got["a/b.txt"] == (3, None) and got["c.txt"] == (0, None) and got["none.txt"][1] == "no content"
    assert got["../evil.txt"][1] == got["/abs.txt"][1] == "a path that leaves the folder" and not os.path.exists(tmp_path / "evil.txt")
    assert sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs) == ["a/b.txt", "c.txt"]
    again = spark.createDataFrame([("c.txt", bytearray(b"new"))], "path string, content binary")
    assert convert.publish(again, folder, overwrite=False).first().error == "the file is there already"
    assert convert.publish(again, folder).first().error is None and open(f"{folder}/c.txt").read() == "new"


def test_publish_tries_again(spark, tmp_path, monkeypatch):
    """A rename that is refused twice succeeds; the temporary file is gone in any case."""
    calls = []

    def refused(a, b, real=os.replace):
        calls.append(a)
        if len(calls) < 3:
            raise PermissionError("locked")
        real(a, b)

    monkeypatch.setattr(os, "replace", refused)
    place = convert.publish.__wrapped__ if hasattr(convert.publish, "__wrapped__") else None
    assert place is None
    import pandas as pd

    class Frame:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return next(run(iter([pd.DataFrame({"path": ["x"], "content": [b"1"]})])))

    out = convert.publish(Frame(), str(tmp_path), waits=(0.001, 0.001, 0.001))
    assert out["error"][0] is None and len(calls) == 3 and os.listdir(tmp_path) == ["x"]


def test_folders(spark, tmp_path):
    """Supported files alone, no results of earlier reads, one of each path whatever its case, a cap."""
    from lakeloom.sources import files

    for name, text in {"b.md": "# B", "A.csv": "x,1", "sub/c.txt": "c", "a.csv.ocr.md": "no", "n.read.md": "no", "x.xyz": "no", "B.MD": "other", "bad.docx": "PK"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    names = lambda most: sorted(r.path.rpartition("/")[2] for r in files.read(spark, str(tmp_path), most).collect())
    assert names(500) == ["A.csv", "B.MD", "bad.docx", "c.txt"] and len(names(2)) == 2
    rows = {r.path.rpartition("/")[2]: r for r in files.inventory(files.read(spark, str(tmp_path))).collect()}
    assert rows["bad.docx"].error and not rows["bad.docx"].usable and rows["B.MD"].characters == 5 and list(rows["B.MD"].titles) == []
    total = files.summary(files.inventory(files.read(spark, str(tmp_path), 2)), there=4).first()
    assert (total.total, total.truncated) == (2, True)


def test_large_workbooks_are_left(spark):
    from lakeloom.operators import recalc

    rows = [("small", "S", 0, 0, "1", "n", None), ("small", "S", 0, 1, "0", "n", "=A1+1"), *[("large", "S", i, 0, "7", "n", "=1+1" if i == 3 else None) for i in range(10)]]
    df = spark.createDataFrame(rows, "book string, sheet string, row int, col int, v string, t string, f string")
    got = {(r.book, r.row, r.col): (r.v, r.state) for r in recalc.recalculate(df, most=5).collect()}
    assert got == {("small", 0, 1): ("2", "ok"), ("large", 3, 0): ("7", "skipped")}
    assert {(r.v, r.state) for r in recalc.recalculate(df, most=None).collect()} == {("2", "ok")}


def test_json_values():
    loop: list = [1]
    loop.append(loop)
    deep: list = []
    for _ in range(70):
        deep = [deep]
    got = sanitize.json_value({"a": float("nan"), "b": [float("inf"), -0.0, 1.5], 3: {2, 1}, "d": dt.date(2024, 1, 2), "x": b"\0\1", "loop": loop, "t": dt.datetime(2024, 1, 2, 3, 4)})
    assert got == {"a": None, "b": [None, None, 1.5], "3": [1, 2], "d": "2024-01-02", "x": "AAE=", "loop": [1, None], "t": "2024-01-02T03:04:00"}
    depth, x = 0, sanitize.json_value(deep)
    while x:
        depth, x = depth + 1, x[0]
    assert depth == 64 and x is None


def test_accounting(spark):
    df = spark.createDataFrame([("a\x00b\x07",), ("fine",), (None,)], "t string")
    rows = [r.x for r in df.select(sanitize.accounted(F.col("t")).alias("x")).collect()]
    assert [(r.text, r.sanitized, r.note) for r in rows[:2]] == [("a�b�", 2, "2 characters that break readers were replaced"), ("fine", 0, None)] and rows[2].text is None


def test_caps():
    assert [ranges.inline_cap(x) for x in (None, "", "abc", "0", 0, "999", 999, "1000", 5000)] == [120_000, 120_000, 120_000, None, None, 120_000, 120_000, 1000, 5000]


def test_pages_between(spark):
    pages = spark.range(1, 6).withColumnRenamed("id", "p")
    assert [r.p for r in ranges.between_pages(pages, "p", 2, None).orderBy("p").collect()] == [2, 3, 4, 5]
    assert ranges.between_pages(pages, "p", None, 2).count() == 2
    for first, last in ((4, 2), (9, None), (None, 0)):
        with pytest.raises(ValueError):
            ranges.between_pages(pages, "p", first, last)


def test_page_choices(spark):
    pages = spark.createDataFrame([(1, i, i % 2 == 0, i == 5) for i in range(1, 51)], "k int, p int, has_text boolean, garbled boolean")
    taken = lambda mode, given: sorted(r.p for r in recognition.chosen_pages(pages, "k", "p", mode, given).where("taken").collect())
    assert taken("auto", False) == [1, 3, 5] and taken("always", False) == [1, 2, 3] and taken("never", True) == []
    assert taken("always", True) == list(range(1, 21)) and taken("auto", True) == list(range(1, 40, 2))


def test_repeated_page_marks(spark):
    text = "first\n_（第 1 页：a）_\nsecond\n_（第 2 页：b（c））_ \nagain\n_（第 1 页：d）_\ntail"
    df = spark.createDataFrame([(1, text), (2, "no marks"), (3, None)], "k int, t string")
    assert {(r.k, r.page): r.body for r in ranges.page_bodies(df, "k", "t").collect()} == {(1, 1): "again", (1, 2): "second"}


def test_memo(spark):
    memo, made = caches.Memo(2), []

    def make(k):
        made.append(k)
        return spark.range(k + 1)

    for k in (1, 2, 1, 3, 1, 2):
        assert memo.get((k,), lambda: make(k)).count() == k + 1  # noqa: B023
    assert made == [1, 2, 3, 2] and len(memo.kept) == 2
    for f in memo.kept.values():
        f.unpersist()


def test_sweep(spark):
    rows = [("/t/a.png", "2024-01-01"), ("/t/b.OCR.md", "2024-01-01"), ("/t/c.read.md.png", "2024-01-01"), ("/t/d.png", "2024-01-09")]
    df = spark.createDataFrame(rows, "path string, day string").select("path", F.to_timestamp("day").alias("modified"))
    assert [r.path for r in caches.expired(df, F.to_timestamp(F.lit("2024-01-10")), 7).collect()] == ["/t/a.png"]


def test_slide_bounds(spark):
    df = spark.createDataFrame([([("a", "s")],), ([("a", "s"), ("b", None)],)], "s array<struct<title:string,subtitle:string>>")
    two = df.where("size(s) = 2")
    assert [x.title for x in two.select(editing.delete_slide(F.col("s"), 1).alias("x")).first().x] == ["b"]
    for bad in (editing.delete_slide(F.col("s"), 1), editing.update_slide(F.col("s"), 2, "x"), editing.delete_slide(F.col("s"), 0)):
        with pytest.raises(Exception, match="slide"):
            df.select(bad).collect()


def test_upper_case_keeps_the_number_of_characters(spark):
    """Conversions' cached texts, whose SQL takes each character by itself."""
    import duckdb

    from lakeloom.functions import textstats as stats

    texts = ["straße ÿ", "ŉ ǰ ﬁ ΐ", "ᾳ ᾀ ῼ dž", "", "plain", "ß"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", stats.upper_each(F.col("t")).alias("u")).collect()
    assert [r.u for r in sorted(rows)] == [duckdb.execute("SELECT upper(?)", [t]).fetchone()[0] for t in texts] + [None]
    assert rows[0].u == "STRAẞE Ÿ"


def test_reading_order_of_boxes_at_one_place(spark, tmp_path):
    """Lines with equal keys stay as the table has them, as in the SQL; their texts would sort otherwise."""
    import duckdb

    from lakeloom import catalog

    rows = [(1, 9001 + 600 * k, 5, 1, 0.05) for k in (7, 3, 9, 0, 5)] + [(1, 12, 9, 2, 0.05)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = catalog.QUERIES["ocr_reading_order"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == con.execute(catalog.ORACLES["ocr_reading_order"]).fetchall()
    assert got[0].text.split("\n")[:3] == ["word13201", "word10801", "word14401"]


def test_sheets_of_cells(spark):
    """Gaps, several sheets, cells twice at a place; and a long sheet, which takes time by its length alone."""
    import time

    schema = "book int, sheet string, row int, col int, v string, t string, f string"
    rows = [(1, "S", 3, 1, None, "n", None), (1, "S", 0, 2, "a", "s", None), (1, "S", 3, 0, "b", "n", "=1"), (1, "A", 1, 1, "z", "s", None), (2, "S", 0, 0, "q", "s", None)]
    got = {r.book: [(s.name, [[c.v for c in x] for x in s.rows]) for s in r.sheets] for r in convert.wide_sheets(spark.createDataFrame(rows, schema), "book").collect()}
    assert got == {1: [("A", [[], ["", "z"]]), ("S", [["", "", "a"], [], [], ["b", None]])], 2: [("S", [["q"]])]}
    for wrong in (rows[0], (1, "S", -1, 0, "x", "s", None), (1, "S", None, 0, "x", "s", None)):
        with pytest.raises(Exception, match="one has none"):
            convert.wide_sheets(spark.createDataFrame([*rows, wrong], schema), "book").collect()
    n, began = 60_000, time.perf_counter()
    long = spark.range(n).selectExpr("1 AS book", "'S' AS sheet", "int(id) AS row", "int(id % 3) AS col", "string(id) AS v", "'n' AS t", "string(null) AS f")
    assert convert.long_cells(convert.wide_sheets(long, "book"), "book").where("v <> ''").count() == n
    assert time.perf_counter() - began < 40


def test_what_a_worker_holds_is_bounded_in_bytes(spark):
    """Batches of long texts end by their size, and files are read in pieces; the training-data operators,
    which bound rows, are left alone."""
    import pandas as pd
    import pyarrow as pa

    from lakeloom.llm import common
    from lakeloom.sources import files, tables

    common.table(spark, "/root/testdata/sf0.001", "documents")
    assert spark.conf.get(tables.BYTES) == "67108864b"
    rows = spark.conf.get(common.BATCH)
    spark.conf.set(common.BATCH, "10000")
    try:
        tables.table(spark, "/root/testdata/sf0.001", "documents")
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
        long = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("t"))
        got = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
        assert sum(got) >= 20_000_000 and max(got) < 6_000_000
    finally:
        spark.conf.set(common.BATCH, rows)
    b = pd.DataFrame({"path": list("abcdefg"), "content": [b"x" * n for n in (3, 3, 9, 1, 0)] + [None, b"x"]})
    assert ["".join(p["path"]) for p in files._pieces(b, 6, 3)] == ["ab", "c", "def", "g"]
    assert list(files._pieces(b.iloc[:0], 6, 3)) == []
