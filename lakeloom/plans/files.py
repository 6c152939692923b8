"""Queries over files that are built on the way: binary formats, edits of packages, text targets, inventories,
and the decisions about pages to read and to recognise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import blocks as bl
from lakeloom.operators import caches, convert, editing, ranges, recognition
from lakeloom.sources.files import inventory, markdown_table, models, summary
from lakeloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _built(df: DataFrame, build: Callable[[pd.Series], bytes], kind: str) -> DataFrame:
    """(path, content): a file of each row of (path, and what ``build`` reads)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"] + "." + kind, "content": [build(r) for _, r in b.iterrows()]})

    return df.mapInPandas(run, "path string, content binary")


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    """path, and the names and keys of a region's nations in the order of keys."""
    named = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    rows = table(spark, folder, "nation").groupBy("n_regionkey").agg(named.alias("n"))
    return rows.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("path"), F.transform("n", lambda x: x["n_name"]).alias("names"), F.transform("n", lambda x: x["n_nationkey"]).alias("keys"))


_REGIONS = "(SELECT 'r' || n_regionkey AS path, list(n_name ORDER BY n_nationkey) AS names, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey)"


@query(f"SELECT path || '.doc' AS path, array_to_string(names, chr(10)) || chr(10) || '中文 ' || len(names) AS text FROM {_REGIONS}")
def legacy_doc(spark: SparkSession, folder: str) -> DataFrame:
    from lakeloom.sources.compound import word_file

    files = _built(_regions(spark, folder), lambda r: word_file([("\r".join(r["names"]) + "\r", True), (f"\x13 PAGE \x14中文\x15 {len(r['names'])}\r", False)]), "doc")
    return models(files).select("path", bl.to_text(F.col("blocks")).alias("text"))


@query("SELECT 'r' || n_regionkey || '.xls' AS path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS even, CAST(CAST('2024-01-01' AS DATE) + CAST(n_nationkey AS INTEGER) AS VARCHAR) AS day FROM nation")
def legacy_xls(spark: SparkSession, folder: str) -> DataFrame:
    from lakeloom.sources.compound import excel_file

    files = _built(_regions(spark, folder), lambda r: excel_file([("S", [[int(k), str(n), bool(k % 2 == 0), ("date", 45292.0 + k)] for k, n in zip(r["keys"], r["names"])])], 1), "xls")
    cells = convert.long_cells(models(files), "path")
    pick = lambda c: F.max(F.when(F.col("col") == c, F.col("v")))
    rows = cells.groupBy("path", "row").agg(pick(0).alias("key"), pick(1).alias("name"), pick(2).alias("even"), pick(3).alias("day"))
    return rows.withColumn("row", F.col("row").cast("long"))


@query(f"SELECT path || '.ppt' AS path, names[1] AS title, array_to_string(names[2:], '|') AS bullets FROM {_REGIONS}")
def legacy_ppt(spark: SparkSession, folder: str) -> DataFrame:
    from lakeloom.sources.compound import slides_file

    files = _built(_regions(spark, folder), lambda r: slides_file([[r["names"][0], "\r".join(r["names"][1:])]]), "ppt")
    one = F.get("slides", F.lit(0))
    return models(files).select("path", one["title"].alias("title"), F.array_join(F.transform(one["bullets"], lambda b: b["text"]), "|").alias("bullets"))


def _documents(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Regions as documents: a heading, a paragraph a nation in two runs, a list."""
    from lakeloom.functions.blocks import block, run
    from lakeloom.sources import slidelike, wordlike

    def build(r: pd.Series) -> bytes:
        if kind == "pptx":
            return slidelike.write_pptx([slidelike.slide(n, subtitle="old name") for n in r["names"]])
        blocks = [block("heading", level=1, text="old plan"), *(block("paragraph", runs=[run("the old na"), run(f"me of {n}", bold=True)]) for n in r["names"])]
        return (wordlike.write_docx if kind == "docx" else wordlike.write_odt)(blocks, {"title": "t"})

    return _built(_regions(spark, folder), build, kind)


def _edited(kind: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        edits = [{"op": "replace_text", "find": "old name", "replace": "new & name"}, {"op": "append_markdown", "text": "## End\n\nlast"}, {"op": "set_meta", "title": "T"}]
        done = convert.edit(_documents(spark, folder, kind), edits)
        back = models(done)
        counts = done.select("path", F.get("counts", F.lit(0)).cast("long").alias("hits"))
        return back.join(counts, "path").select("path", "hits", F.col("meta")["title"].alias("title"), bl.to_text(F.col("blocks")).alias("text"))

    run.__name__ = f"edit_{kind}"
    query(f"SELECT path || '.{kind}' AS path, len(names) AS hits, 'T' AS title, 'old plan' || chr(10) || array_to_string(list_transform(names, lambda n: 'the new & name of ' || n), chr(10)) || chr(10) || 'End' || chr(10) || 'last' AS text FROM {_REGIONS}")(run)


_edited("docx")
_edited("odt")


@query(f"SELECT path || '.pptx' AS path, array_to_string(list_concat(['FIRST'], names[2:], ['added']), '|') AS titles, len(names) - 1 AS subtitles FROM {_REGIONS}")
def edit_pptx(spark: SparkSession, folder: str) -> DataFrame:
    """A slide added at either end, one retitled, one deleted."""
    edits = [{"op": "add_slide", "slide": {"title": "zero"}, "index": 1}, {"op": "update_slide", "index": 1, "title": "FIRST"}, {"op": "delete_slide", "index": 2}, {"op": "add_slide", "slide": {"title": "added"}}]
    back = models(convert.edit(_documents(spark, folder, "pptx"), edits))
    return back.select("path", F.array_join(F.transform("slides", lambda s: s["title"]), "|").alias("titles"), F.size(F.filter("slides", lambda s: s["subtitle"].isNotNull())).cast("long").alias("subtitles"))


@query(f"SELECT path, array_to_string(list_concat(names[1:1], ['new'], names[3:], ['last']), '|') AS titles FROM {_REGIONS}")
def deck_edits(spark: SparkSession, folder: str) -> DataFrame:
    """The same on deck models as columns."""
    slide = lambda t: F.struct(F.lit("content").alias("layout"), t.alias("title"), F.lit(None).cast("string").alias("subtitle"))
    decks = _regions(spark, folder).select("path", F.transform("names", slide).alias("slides"))
    more = editing.update_slide(editing.add_slide(F.col("slides"), slide(F.lit("last"))), 2, title="new")
    gone = editing.delete_slide(F.concat(F.array(slide(F.lit("zero"))), more), 1)
    return decks.select("path", F.array_join(F.transform(gone, lambda s: s["title"]), "|").alias("titles"))


def _books(spark: SparkSession, folder: str) -> DataFrame:
    """Regions as workbook models."""
    cell = lambda v, t: F.struct(v.cast("string").alias("v"), F.lit(t).alias("t"), F.lit(None).cast("string").alias("f"))
    rows = F.zip_with("keys", "names", lambda k, n: F.array(cell(k, "n"), cell(n, "s")))
    none = F.lit(None)
    return _regions(spark, folder).select(
        "path", F.lit("workbook").alias("model"), F.lit("xlsx").alias("format"), F.create_map(F.lit("title"), F.lit("t")).alias("meta"), none.cast(f"array<{bl.BLOCK}>").alias("blocks"),
        F.array(F.struct(F.lit("S").alias("name"), rows.alias("rows"))).alias("sheets"), none.cast(f"array<{bl.SLIDE}>").alias("slides"), none.cast("string").alias("error"),
    )


_ROWS = "list_transform(range(1, len(names) + 1), lambda i: keys[i] || '{}' || names[i])"


@query(f"SELECT path, array_to_string({_ROWS.format(chr(9))}, chr(13) || chr(10)) || chr(13) || chr(10) AS text FROM {_REGIONS}")
def render_tsv(spark: SparkSession, folder: str) -> DataFrame:
    return convert.render(_books(spark, folder), "tsv").select("path", F.decode("content", "utf-8").alias("text"))


@query(f"SELECT path, '| ' || array_to_string({_ROWS.format(' | ')}[1:1], '') || ' |' || chr(10) || '| --- | --- |' || array_to_string(list_transform({_ROWS.format(' | ')}[2:], lambda x: chr(10) || '| ' || x || ' |'), '') AS text FROM {_REGIONS}")
def render_md(spark: SparkSession, folder: str) -> DataFrame:
    return convert.render(_books(spark, folder), "md").select("path", F.decode("content", "utf-8").alias("text"))


@query(f"SELECT path, array_to_string(list_transform({_ROWS.format(' | ')}, lambda x: '| ' || x || ' |'), chr(10)) AS text FROM {_REGIONS}")
def render_txt(spark: SparkSession, folder: str) -> DataFrame:
    return convert.render(_books(spark, folder), "txt").select("path", F.decode("content", "utf-8").alias("text"))


@query(f"SELECT path, 'workbook' AS kind, 't' AS title, names[1] AS first, len(names) AS rows FROM {_REGIONS}")
def render_json(spark: SparkSession, folder: str) -> DataFrame:
    j = convert.render(_books(spark, folder), "json").select("path", F.decode("content", "utf-8").alias("j"))
    at = lambda p: F.get_json_object("j", p)
    rows = F.json_array_length(at("$.sheets[0].rows")).cast("long")
    return j.select("path", at("$.kind").alias("kind"), at("$.meta.title").alias("title"), at("$.sheets[0].rows[0][1].v").alias("first"), rows.alias("rows"))


@query(f"SELECT path, '国 ' || array_to_string(names, ' 与 ') AS text FROM {_REGIONS}")
def pdf_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Latin and Chinese text, written as PDF and read back."""
    text = F.concat(F.lit("国 "), F.array_join("names", " 与 "))
    runs = F.from_json(F.to_json(F.array(F.struct(text.alias("text")))), f"array<{bl.RUN}>")
    docs = _books(spark, folder).select("path", "meta", "error", "sheets", "slides").join(_regions(spark, folder), "path").withColumn("blocks", F.array(convert._block("paragraph", runs=runs)))
    back = models(convert.render(docs, "pdf").select(F.concat("path", F.lit(".pdf")).alias("path"), "content"))
    found = bl.to_text(F.filter("blocks", lambda b: b["type"] != "heading"))
    return back.select(F.replace("path", F.lit(".pdf"), F.lit("")).alias("path"), F.trim(F.regexp_replace(found, r"\s+", " ")).alias("text"))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Files of several kinds: a broken one, workbooks, and PDF files of 14 pages, every third of them garbled."""
    from lakeloom.functions.blocks import block, run
    from lakeloom.sources import pdf

    def pages(r: pd.Series) -> bytes:
        out = []
        for k in range(14):
            out += [block("paragraph", runs=[run("\ue0a1" * 90 if k % 3 == 2 and len(r["names"]) % 2 else "words of a page " * 8)]), block("pagebreak")]
        return pdf.write(out[:-1])

    regions = _regions(spark, folder)
    texts = convert.render(_books(spark, folder), "csv").select(F.concat("path", F.lit(".csv")).alias("path"), "content")
    broken = regions.limit(1).select(F.lit("broken|x.docx").alias("path"), F.lit(b"PK nothing").alias("content"))
    return _built(regions, pages, "pdf").union(texts).union(broken)


_PDFS = f"(SELECT path || '.pdf' AS path, len(names) % 2 = 1 AS bad FROM {_REGIONS})"


@query(f"SELECT path, 14 AS pages, CASE WHEN bad THEN 4 ELSE 0 END AS garbled, CASE WHEN bad THEN '3,6,9,12' ELSE '' END AS garbled_pages, NOT bad AS usable, 1 AS batches FROM {_PDFS} UNION ALL SELECT path || '.csv', NULL, 0, '', true, 1 FROM {_REGIONS} UNION ALL SELECT 'broken|x.docx', NULL, 0, '', false, 1")
def inventory_rows(spark: SparkSession, folder: str) -> DataFrame:
    return inventory(models(_mixed(spark, folder))).select("path", "pages", "garbled", "garbled_pages", "usable", "batches")


@query(f"SELECT 2 * count(*) + 1 AS total, 2 * count(*) AS ok, 1 AS failed, 2 AS skipped, true AS truncated, 2 * count(*) + 1 AS batches, (SELECT coalesce(string_agg(path || '（第 3,6,9,12 页）', '、' ORDER BY path), '') FROM {_PDFS} WHERE bad) AS garbled FROM {_REGIONS}")
def inventory_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summary(inventory(models(_mixed(spark, folder))), there=1000, skipped=2).select("total", "ok", F.col("failed").cast("int").alias("failed"), "skipped", "truncated", "batches", "garbled")


@query(f"WITH l AS (SELECT 'broken|x.docx' AS path, '| broken\\|x.docx | — | — | — | — | — | — | — | ❌ File is not a zip file |' AS line UNION ALL SELECT path || '.csv', '| ' || path || '.csv | csv | — | ' || list_sum(list_transform(range(1, len(names) + 1), lambda i: length(names[i]) + length(CAST(keys[i] AS VARCHAR)))) || ' | ✓ | 0 | 0 | 1 | Sheet1:' || len(names) || '行 |' FROM {_REGIONS}) SELECT '| 文件 | 格式 | 页 | 字符 | 文字层 | 扫描页 | 乱码页 | 建议批次 | 备注 |' || chr(10) || '| --- | --- | ---: | ---: | --- | ---: | ---: | ---: | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY path) AS table FROM l")
def inventory_table(spark: SparkSession, folder: str) -> DataFrame:
    return markdown_table(inventory(models(_mixed(spark, folder).where("path NOT LIKE '%.pdf'"))))


@query("SELECT conv_id, CAST(turn + 1 AS INTEGER) AS page, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM conversations")
def page_bodies(spark: SparkSession, folder: str) -> DataFrame:
    page = F.concat(F.col("text"), F.lit("\n_（第 "), (F.col("turn") + 1).cast("string"), F.lit(" 页：识别（9 框，置信 0.98））_  \n"))
    turns = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))), lambda x: x["p"]), "").alias("t"))
    return ranges.page_bodies(turns, "conv_id", "t")


@query("WITH d AS (SELECT doc_id, CAST(ceil(length(text) / 100) AS INTEGER) AS pages, doc_id % 3 = 0 AS bad FROM documents WHERE length(text) > 0), s AS (SELECT *, CASE WHEN bad THEN 20 WHEN pages > 12 THEN 15 ELSE greatest(pages, 1) END AS step FROM d), b AS (SELECT doc_id, pages, step, unnest(range(1, pages + 1, CAST(step AS BIGINT))) AS first FROM s) SELECT doc_id, CAST(first AS INTEGER) AS first_page, CAST(least(first + step - 1, pages) AS INTEGER) AS last_page FROM b")
def read_plan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.ceil(F.length("text") / 100).cast("int").alias("pages"), (F.col("doc_id") % 3 == 0).alias("bad"))
    return ranges.read_plan(docs, "doc_id", "pages", "bad")


@query("SELECT conv_id, turn FROM conversations WHERE turn BETWEEN 1 AND 2")
def page_span(spark: SparkSession, folder: str) -> DataFrame:
    return ranges.between_pages(table(spark, folder, "conversations"), "turn", 1, 2).select("conv_id", "turn")


@query("WITH h AS (SELECT doc_id, text, left(text, 1000) AS head FROM documents), p AS (SELECT *, CASE WHEN contains(head, chr(10)) THEN length(head) - strpos(reverse(head), chr(10)) ELSE -1 END AS pos FROM h) SELECT doc_id, CAST(CASE WHEN length(text) <= 1000 THEN length(text) WHEN pos > 600 THEN pos ELSE 1000 END AS INTEGER) AS kept, length(text) > 1000 AS truncated, CAST(length(text) AS INTEGER) AS characters FROM p")
def inline_capped(spark: SparkSession, folder: str) -> DataFrame:
    one = ranges.capped(F.col("text"), ranges.inline_cap("1000"))
    return table(spark, folder, "documents").select("doc_id", one.alias("c")).select("doc_id", F.length("c.content").alias("kept"), "c.truncated", "c.characters")


@query("WITH b AS (SELECT l_orderkey AS page, count(*) AS n, sum(0.5 + CAST(l_discount AS DOUBLE) * 0.37) AS total, sum(CASE WHEN length(CAST(l_partkey AS VARCHAR)) + 2 <= 6 THEN 1 ELSE 0 END) AS short FROM lineitem GROUP BY l_orderkey) SELECT page, CASE WHEN page % 5 = 0 THEN NULL ELSE 100 END AS code, CASE WHEN page % 5 = 0 THEN 0 ELSE CAST(n AS INTEGER) END AS boxes, CASE WHEN page % 5 = 0 THEN 0 ELSE floor(total / n * 1000 + 0.5) / 1000 END AS score, CASE WHEN page % 5 = 0 THEN 1 ELSE floor(short / n * 100 + 0.5) / 100 END AS short_share FROM b")
def ocr_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Result lines, every fifth of them no JSON."""
    box = F.struct(F.array(F.array(F.lit(1.0))).alias("box"), F.concat(F.lit("no"), F.col("l_partkey").cast("string")).alias("text"), (F.lit(0.5) + F.col("l_discount").cast("double") * 0.37).alias("score"))
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.to_json(F.struct(F.lit(100).alias("code"), F.collect_list(box).alias("data"))).alias("j"))
    line = F.when(F.col("page") % 5 == 0, "no json").otherwise(F.col("j"))
    return lines.select("page", recognition.parsed(line).alias("r")).select("page", "r.*")


def _ocr_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("source", "doc_id", (F.col("doc_id") % 4 != 0).alias("has_text"), (F.col("doc_id") % 7 == 0).alias("garbled"))


@query("WITH w AS (SELECT source, doc_id, doc_id % 4 = 0 OR doc_id % 7 = 0 AS wanted FROM documents) SELECT *, wanted AND sum(CASE WHEN wanted THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 3 AS taken FROM w")
def ocr_select(spark: SparkSession, folder: str) -> DataFrame:
    return recognition.chosen_pages(_ocr_pages(spark, folder), "source", "doc_id", "auto", given=False).select("source", "doc_id", "wanted", "taken")


@query("SELECT source, doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS INTEGER) AS chunk FROM documents")
def ocr_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return recognition.chunks(_ocr_pages(spark, folder), "source", "doc_id").select("source", "doc_id", "chunk")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5 AS granted FROM documents WHERE doc_id % 4 = 0")
def ocr_escalate(spark: SparkSession, folder: str) -> DataFrame:
    return recognition.escalated(_ocr_pages(spark, folder), "source", "doc_id", "has_text", 5).select("source", "doc_id", "granted")


@query("WITH w AS (SELECT doc_id % 20 AS book, doc_id // 20 AS page, l.doc_id IS NOT NULL AS hit FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)), g AS (SELECT book, page, page - row_number() OVER (PARTITION BY book ORDER BY page) AS k FROM w WHERE NOT hit), r AS (SELECT book, min(page) AS lo, max(page) AS hi FROM g GROUP BY book, k), m AS (SELECT book, string_agg(CASE WHEN hi > lo THEN lo || '-' || hi ELSE CAST(lo AS VARCHAR) END, ',' ORDER BY lo) AS missing FROM r GROUP BY book) SELECT book, count(*) FILTER (WHERE hit) AS covered, count(*) AS total, coalesce(any_value(missing), '') AS missing FROM w LEFT JOIN m USING (book) GROUP BY book")
def cache_ranges(spark: SparkSession, folder: str) -> DataFrame:
    pages = lambda name: table(spark, folder, name).select((F.col("doc_id") % 20).alias("book"), F.floor(F.col("doc_id") / 20).cast("long").alias("page"))
    return caches.coverage(pages("documents"), pages("labels"), "book", "page")


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND event_id % 3 <> 0")
def cache_sweep(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    name = F.concat(F.lit("/tmp/p"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, ".OCR.md").otherwise(".png"))
    files = events.select("event_id", name.alias("path"), F.col("ts").alias("modified"))
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return caches.expired(files, now, 7).select("event_id")


@query("SELECT n_nationkey, round((n_nationkey + 1) / 64, 6) AS ink FROM nation")
def ink_share(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures of 8 by 8 pixels, as many of them dark as the nation's key tells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import struct
        import zlib

        from lakeloom.sources import image

        def png(n: int) -> bytes:
            piece = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
            grey = [40 if k <= n else 230 for k in range(64)]
            lines = b"".join(bytes([1]) + bytes([grey[y * 8], *((grey[y * 8 + x] - grey[y * 8 + x - 1]) & 255 for x in range(1, 8))]) for y in range(8))
            return b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)) + piece(b"IDAT", zlib.compress(lines)) + piece(b"IEND", b"")

        for b in batches:
            yield pd.DataFrame({"n_nationkey": b["n_nationkey"], "ink": [round(image.ink(png(int(n))), 6) for n in b["n_nationkey"]]})

    return table(spark, folder, "nation").select("n_nationkey").mapInPandas(run, "n_nationkey int, ink double")


@query("SELECT c_nationkey, CAST(count(*) AS INTEGER) AS rows, 2 AS columns, CAST(least(20, count(*)) AS INTEGER) AS titles FROM customer GROUP BY c_nationkey")
def model_stats(spark: SparkSession, folder: str) -> DataFrame:
    cell = lambda c: F.struct(F.col(c).cast("string").alias("v"), F.lit("s").alias("t"), F.lit(None).cast("string").alias("f"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", F.array(cell("c_custkey"), cell("c_name")).alias("r")))), lambda x: x["r"])
    books = table(spark, folder, "customer").groupBy("c_nationkey").agg(rows.alias("rows"))
    sheet = F.get(bl.sheet_stats(F.array(F.struct(F.lit("S").alias("name"), F.col("rows")))), F.lit(0))
    decks = F.transform("rows", lambda r: F.struct(F.get(r, F.lit(1))["v"].alias("title"), F.lit(0).alias("images")))
    return books.select("c_nationkey", sheet["rows"].alias("rows"), sheet["columns"].alias("columns"), F.size(bl.slide_stats(decks)["titles"]).alias("titles"))


def _default(df: DataFrame, key: str, text: Column) -> DataFrame:
    return df.select(key, bl.normalised(F.array(convert._block("paragraph", text=text).withField("type", F.lit(None).cast("string")), convert._block("heading", text=text, level=F.lit(9)), F.lit(None).cast(bl.BLOCK), convert._block("list"))).alias("b"))


@query("SELECT n_nationkey, 'paragraph,heading,list' AS kinds, n_name AS shown, 6 AS level, 0 AS items FROM nation")
def normalised_blocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = _default(table(spark, folder, "nation"), "n_nationkey", F.col("n_name"))
    at = lambda k: F.get("b", F.lit(k))
    return rows.select("n_nationkey", F.array_join(F.transform("b", lambda b: b["type"]), ",").alias("kinds"), bl.runs_text(at(0)["runs"]).alias("shown"), at(1)["level"].alias("level"), F.size(at(2)["items"]).alias("items"))


@query("SELECT conv_id, '序号|标题|要点|备注' AS head, count(*) AS rows, '· a' || chr(10) || '· b' AS points FROM conversations GROUP BY conv_id")
def slides_as_workbook(spark: SparkSession, folder: str) -> DataFrame:
    item = lambda t: F.struct(F.lit(0).alias("level"), F.lit(t).alias("text"))
    slide = F.struct(F.lit("content").alias("layout"), F.col("role").alias("title"), F.array(item("a"), item("b")).alias("bullets"), F.lit(None).cast("string").alias("notes"))
    decks = table(spark, folder, "conversations").groupBy("conv_id").agg(F.collect_list(slide).alias("slides"))
    rows = F.get(convert.slides_to_workbook(F.col("slides")), F.lit(0))["rows"]
    text = lambda r, k: F.get(F.get(rows, F.lit(r)), F.lit(k))["v"]
    head = F.array_join(F.transform(F.get(rows, F.lit(0)), lambda c: c["v"]), "|")
    return decks.select("conv_id", head.alias("head"), (F.size(rows) - 1).cast("long").alias("rows"), text(1, 2).alias("points"))


@query(f"SELECT path || '.md' AS path, 2 AS sheets, len(names) + 1 AS first, 2 AS second, names[1] AS name FROM {_REGIONS}")
def markdown_as_workbook(spark: SparkSession, folder: str) -> DataFrame:
    """Tables become sheets."""
    rows = F.array_join(F.transform("names", lambda n: F.concat(F.lit("| "), n, F.lit(" | x |"))), "\n")
    text = F.concat(F.lit("intro\n\n| name | k |\n|---|---|\n"), rows, F.lit("\n\n| a |\n|---|\n| b |\n"))
    files = _regions(spark, folder).select(F.concat("path", F.lit(".md")).alias("path"), F.encode(text, "utf-8").alias("content"))
    sheets = models(files).select("path", convert.document_to_workbook(F.col("blocks")).alias("s"))
    at = lambda k: F.get("s", F.lit(k))["rows"]
    return sheets.select("path", F.size("s").alias("sheets"), F.size(at(0)).cast("long").alias("first"), F.size(at(1)).alias("second"), F.get(F.get(at(0), F.lit(1)), F.lit(0))["v"].alias("name"))


@query(f"SELECT path, '# A' || chr(13) || chr(10) || '\"x, y\"' || chr(13) || chr(10) || '# B' || chr(13) || chr(10) || array_to_string(names, chr(13) || chr(10)) || chr(13) || chr(10) AS text FROM {_REGIONS}")
def csv_of_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Several sheets in one file, each under its name."""
    cell = lambda v: F.array(F.struct(v.alias("v"), F.lit("s").alias("t"), F.lit(None).cast("string").alias("f")))
    sheet = lambda n, rows: F.struct(F.lit(n).alias("name"), rows.alias("rows"))
    books = _books(spark, folder).drop("sheets").join(_regions(spark, folder), "path")
    books = books.withColumn("sheets", F.array(sheet("A", F.array(cell(F.lit("x, y")))), sheet("B", F.transform("names", cell))))
    return convert.render(books, "csv").select("path", F.replace(F.decode("content", "utf-8"), F.lit("\ufeff"), F.lit("")).alias("text"))


@query("SELECT c_nationkey AS book, count(*) AS cells, CAST(max(c_custkey) AS VARCHAR) AS last FROM customer GROUP BY c_nationkey")
def cells_as_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Cells as rows, put together as sheets and taken apart again."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    cells = table(spark, folder, "customer").select(F.col("c_nationkey").alias("book"), F.lit("S").alias("sheet"), place.alias("row"), (place % 3).alias("col"), F.col("c_custkey").cast("string").alias("v"), F.lit("n").alias("t"), F.lit(None).cast("string").alias("f"))
    back = convert.long_cells(convert.wide_sheets(cells, "book"), "book").where("v <> ''")
    return back.groupBy("book").agg(F.count("*").alias("cells"), F.max(F.col("v").cast("long")).cast("string").alias("last"))


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\r?\\n'), lambda x: trim(x) <> '')) AS INTEGER) AS paragraphs FROM documents")
def text_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.size(bl.paragraphs(F.col("text"))).alias("paragraphs"))
