"""Queries over files and pages: identity, caches, recognition, edits, sanitizing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import sanitize
from lakeloom.functions import textstats as stats
from lakeloom.operators import caches, editing, recognition
from lakeloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


@query("SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def content_hash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", caches.content_key(F.col("text")).alias("digest"))
    return caches.first_of(docs, F.col("digest"), "doc_id").select("doc_id", "digest", "copies")


@query("SELECT min(c_custkey) AS c_custkey, left(sha256(lower('/data/' || c_mktsegment)), 8) AS key FROM customer GROUP BY lower(c_mktsegment), c_mktsegment")
def path_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One file of each path, whatever its case."""
    path = F.concat(F.lit("/data/"), F.col("c_mktsegment"))
    rows = table(spark, folder, "customer").select("c_custkey", path.alias("path"), F.lower(path).alias("low"))
    return caches.first_of(rows, F.col("low"), "c_custkey").select("c_custkey", caches.path_key(F.col("path")).alias("key"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def cache_missing(spark: SparkSession, folder: str) -> DataFrame:
    return caches.missing(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels").select("doc_id"), ["doc_id"])


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'parser-missing' WHEN doc_id % 7 = 1 THEN 'parser' WHEN doc_id % 7 = 2 THEN 'identity-missing' WHEN doc_id % 7 = 3 THEN 'path-mismatch' WHEN doc_id % 7 = 4 THEN 'content-mismatch' ELSE 'ok' END AS state FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id)")
def cache_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Cache entries of labelled documents against their sources."""
    k = F.col("doc_id") % 7
    entries = table(spark, folder, "labels").select("doc_id").distinct().select("doc_id", F.when(k == 1, "v1").when(k != 0, "v2").alias("parser"), F.when(k != 2, F.when(k == 3, "x").otherwise("doc")).alias("path"), F.when(k == 4, "other").alias("changed"))
    rows = table(spark, folder, "documents").select("doc_id", caches.content_key(F.col("text")).alias("digest")).join(entries, "doc_id")
    known = F.coalesce("changed", "digest")
    return rows.select("doc_id", caches.validity(F.col("parser"), "v2", F.col("path").isNotNull(), F.lit(True), F.col("path") == "doc", known == F.col("digest")).alias("state"))


@query("WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fresh' ELSE 'cached' END AS engine FROM (SELECT doc_id FROM l UNION SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def cache_merge(spark: SparkSession, folder: str) -> DataFrame:
    cached = table(spark, folder, "labels").select("doc_id", F.lit("cached").alias("engine")).distinct()
    fresh = table(spark, folder, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit("fresh").alias("engine"))
    return caches.merge(cached, fresh, ["doc_id"])


@query("SELECT source, count(*) AS total, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def cache_coverage(spark: SparkSession, folder: str) -> DataFrame:
    have = table(spark, folder, "labels").select("doc_id").distinct().withColumn("hit", F.lit(1))
    rows = table(spark, folder, "documents").select("doc_id", "source").join(have, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.count("hit").alias("covered"), F.count_if(F.col("hit").isNull()).alias("missing"))


@query("SELECT n_nationkey, 'x' || n_nationkey AS engine, n_name AS name FROM nation")
def manifest_fields(spark: SparkSession, folder: str) -> DataFrame:
    head = F.concat(F.lit("engine: x"), F.col("n_nationkey"), F.lit(" | name: "), F.col("n_name"), F.lit(" | junk"))
    return table(spark, folder, "nation").select("n_nationkey", caches.manifest(head).alias("m")).select("n_nationkey", F.col("m")["engine"].alias("engine"), F.col("m")["name"].alias("name"))


_GARBLED = "(SELECT doc_id, text, length(text) < 200 AS garbled FROM documents)"


def _pages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents")
    pages = docs.select("doc_id", "text", (F.length("text") < 200).alias("garbled"))
    return pages, docs.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("cached "), stats.upper_each(F.col("text"))).alias("cached"))


@query(f"SELECT doc_id, sha256(CASE WHEN garbled AND doc_id % 2 = 0 THEN 'cached ' || upper(text) ELSE text END) AS digest FROM {_GARBLED}")
def conversion_substitute(spark: SparkSession, folder: str) -> DataFrame:
    pages, cached = _pages(spark, folder)
    return caches.substitute(pages, cached, ["doc_id"])[0].select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"SELECT doc_id FROM {_GARBLED} WHERE garbled AND doc_id % 2 <> 0")
def conversion_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled documents for which there is no cached text."""
    pages, cached = _pages(spark, folder)
    return caches.substitute(pages, cached, ["doc_id"])[1]


def _boxes(spark: SparkSession, folder: str, placed: bool = False) -> DataFrame:
    """Line items as boxes on pages: a page is an order. Pages of many and of short boxes, which orders
    do not make, come from the nations. ``placed`` adds file and nth: where an item's row is."""
    own = (F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("nth")) if placed else ()
    none = (F.lit(""), F.lit(0).cast("long")) if placed else ()
    items = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 600).alias("x"), (F.col("l_suppkey") * 7 % 800).alias("y"), (0.8 + F.col("l_discount").cast("double") * 2).alias("score"), F.concat(F.lit("word"), F.col("l_partkey").cast("string")).alias("text"), *own)
    key = F.col("n_nationkey")
    many = table(spark, folder, "nation").select(key, F.explode(F.sequence(F.lit(1), F.when(key % 2 == 0, 50).otherwise(35))).alias("pos"))
    return items.union(many.select((-10 * key - 5).cast("long"), "pos", (F.col("pos") * 11 % 600).cast("long"), (F.col("pos") * 16).cast("long"), F.lit(0.93), F.concat(F.when(key % 3 == 0, "w").otherwise("longword"), F.col("pos").cast("string")), *none))


_BOXES = "WITH b AS (SELECT l_orderkey AS page, l_linenumber AS pos, l_partkey % 600 AS x, l_suppkey * 7 % 800 AS y, 0.8 + CAST(l_discount AS DOUBLE) * 2 AS score, 'word' || l_partkey AS text FROM lineitem UNION ALL SELECT CAST(-10 * n_nationkey - 5 AS BIGINT), CAST(k AS INTEGER), k * 11 % 600, k * 16, 0.93, CASE WHEN n_nationkey % 3 = 0 THEN 'w' ELSE 'longword' END || k FROM nation, (SELECT unnest(range(1, 51)) AS k) WHERE n_nationkey % 2 = 0 OR k <= 35)"


@query(f"{_BOXES}, p AS (SELECT page, count(*) AS boxes, floor(avg(score) * 1000 + 0.5) / 1000 AS score, floor(avg(CASE WHEN length(text) <= 6 THEN 1.0 ELSE 0 END) * 100 + 0.5) / 100 AS short_share FROM b GROUP BY page) SELECT page, CASE WHEN page % 10 = 0 THEN 'blank' WHEN page % 10 = 1 THEN 'code' WHEN page % 10 = 2 THEN 'none' WHEN score < 0.88 THEN 'score' WHEN boxes >= 45 AND score < 0.95 THEN 'dense' WHEN short_share > 0.6 AND boxes >= 30 AND score < 0.95 THEN 'short' ELSE 'ok' END AS verdict FROM p")
def ocr_gate(spark: SparkSession, folder: str) -> DataFrame:
    pages = recognition.page_stats(_boxes(spark, folder), ["page"])
    code = F.when(F.col("page") % 10 == 0, 101).when(F.col("page") % 10 == 1, 203).when(F.col("page") % 10 != 2, 100)
    return pages.select("page", recognition.gate(code, F.col("boxes"), F.col("score"), F.col("short_share")).alias("verdict"))


@query(f"{_BOXES} SELECT page, string_agg(text, chr(10) ORDER BY y // 24, x, pos) AS text FROM b GROUP BY page")
def ocr_reading_order(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes at the same place follow in the order of their rows in the table."""
    return recognition.reading_order(_boxes(spark, folder, placed=True), ["page"], found=("file", "nth"))


@query(f"{_BOXES} SELECT page, pos AS try, round(score, 6) AS score FROM b WHERE score >= 0.88 QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, pos) = 1")
def ocr_best_retry(spark: SparkSession, folder: str) -> DataFrame:
    tries = _boxes(spark, folder).select("page", F.col("pos").alias("try"), "score", (F.col("score") >= 0.88).alias("ok"))
    return recognition.best_retry(tries, ["page"]).withColumn("score", F.round("score", 6))


@query(f"{_BOXES} SELECT page, pos, x, sum(x) OVER (PARTITION BY page ORDER BY pos, x, y ROWS UNBOUNDED PRECEDING) <= 900 AS granted FROM b")
def ocr_budget(spark: SparkSession, folder: str) -> DataFrame:
    return recognition.within_budget(_boxes(spark, folder), "page", ["pos", "x", "y"], "x", 900).select("page", "pos", "x", "granted")


@query(f"{_BOXES}, g AS (SELECT page, count(*) AS n, count(DISTINCT least(9, y * 10 // 800)) AS bands, max(y) AS low FROM b GROUP BY page) SELECT page, bands, n >= 3 AND bands < 7 AND low < 640 AS gap FROM g")
def ocr_layout_gap(spark: SparkSession, folder: str) -> DataFrame:
    return recognition.layout_gap(_boxes(spark, folder), ["page"], 800)


@query("SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.q = 1 THEN 'ocr' WHEN length(text) < 60 THEN '(blank)' WHEN length(text) < 120 THEN '(no text)' ELSE 'layer' END AS shown FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l USING (doc_id)")
def ocr_provenance(spark: SparkSession, folder: str) -> DataFrame:
    marks = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    rows = table(spark, folder, "documents").select("doc_id", F.length("text").alias("n")).join(marks, "doc_id", "left")
    return rows.select("doc_id", recognition.provenance(F.when(F.col("q") == 1, "ocr"), F.col("n") < 60, F.col("n") >= 120, F.lit("layer")).alias("shown"))


@query("SELECT conv_id, turn, text || chr(10) || 'Sure enough, revenue rose.' || chr(10) || 'here is more' || chr(10) || chr(10) || 'tail' AS cleaned FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations)")
def ocr_transcript(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of talk go; ordinary lines that begin alike stay."""
    line = F.trim(F.regexp_replace("text", r"\s+", " "))
    said = F.concat(F.lit("该图片为扫描件。\nHere is the text:\n```text\n"), line, F.lit("\nSure enough, revenue rose.\n```\nUncertain: the last line\nhere is more\n图片显示表格。\n\nTranscription:\n\n\n\ntail"))
    return table(spark, folder, "conversations").select("conv_id", "turn", recognition.clean_transcript(said).alias("cleaned"))


@query("SELECT doc_id, sha256(replace(text, 'the', 'a$1')) AS digest, (length(text) - length(replace(text, 'the', ''))) // 3 AS hits, sha256(regexp_replace(text, '[0-9]+', '#', 'g')) AS masked FROM documents")
def replace_text(spark: SparkSession, folder: str) -> DataFrame:
    new, hits = editing.replace_text(F.col("text"), "the", "a$1")
    masked, _ = editing.replace_text(F.col("text"), "[0-9]+", "#", regex=True)
    return table(spark, folder, "documents").select("doc_id", F.sha2(new, 256).alias("digest"), hits.cast("long").alias("hits"), F.sha2(masked, 256).alias("masked"))


@query("SELECT n_nationkey, CASE WHEN n_name = 'CHINA' THEN 'X' ELSE n_name END AS whole, replace(n_name, 'AN', '_') AS part FROM nation")
def replace_value(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("n_name")
    return table(spark, folder, "nation").select("n_nationkey", editing.replace_value(v, "CHINA", "X").alias("whole"), editing.replace_value(v, "AN", "_", whole=False).alias("part"))


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nation").select(F.concat(F.lit("S"), F.col("n_regionkey").cast("string")).alias("sheet"), "n_nationkey", F.col("n_name").alias("v"))
    return editing.number_rows(rows, ["sheet"], ["n_nationkey"]).select("sheet", "row", F.lit(0).alias("col"), "v")


_GRID = "WITH c AS (SELECT 'S' || n_regionkey AS sheet, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row, 0 AS col, n_name AS v FROM nation)"


@query(f"{_GRID}, u AS (SELECT 'S1' AS sheet, 0 AS row, 0 AS col, 'new' AS v UNION ALL SELECT 'S1', 40, 2, 'far') SELECT * FROM c WHERE NOT (sheet = 'S1' AND row = 0) UNION ALL SELECT * FROM u")
def set_cell(spark: SparkSession, folder: str) -> DataFrame:
    updates = spark.createDataFrame([("S1", 0, 0, "new"), ("S1", 40, 2, "far")], "sheet string, row int, col int, v string")
    return editing.set_cells(_grid(spark, folder), updates)


@query(f"{_GRID} SELECT * FROM c UNION ALL SELECT sheet, max(row) + 1 + k AS row, 0, 'row' || k FROM c, (SELECT unnest([0, 1]) AS k) WHERE sheet = 'S2' GROUP BY sheet, k UNION ALL SELECT 'S9', 0, 0, 'first'")
def append_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([("S2", 0, 0, "row0"), ("S2", 1, 0, "row1"), ("S9", 0, 0, "first")], "sheet string, row int, col int, v string")
    return editing.append_rows(_grid(spark, folder), rows)


@query("SELECT pos, sheet FROM (SELECT CAST(r_regionkey AS BIGINT) AS pos, CASE WHEN r_name = 'ASIA' THEN 'East' ELSE r_name END AS sheet FROM region WHERE r_name <> 'AFRICA') UNION ALL SELECT 5, 'Notes'")
def sheet_ops(spark: SparkSession, folder: str) -> DataFrame:
    sheets = table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("sheet"))
    return editing.delete_sheet(editing.rename_sheet(editing.add_sheet(sheets, "Notes"), "ASIA", "East"), "AFRICA")


@query("SELECT doc_id, sha256(regexp_replace(text, '\\s+$', '') || chr(10) || 'end' || chr(10)) AS appended, sha256('start' || chr(10) || text) AS prepended FROM documents")
def append_prepend(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", F.sha2(editing.append_text(t, "end"), 256).alias("appended"), F.sha2(editing.prepend_text(t, "start"), 256).alias("prepended"))


@query("SELECT n_nationkey, 'new' AS title, n_name AS author, round(least(451.3, (n_nationkey + 1) * 37.5), 4) AS width FROM nation")
def meta_and_images(spark: SparkSession, folder: str) -> DataFrame:
    meta = editing.set_meta(F.create_map(F.lit("title"), F.lit("old"), F.lit("author"), F.col("n_name")), {"title": "new"})
    w, _ = editing.image_points((F.col("n_nationkey") + 1) * 50.0, F.lit(100.0))
    return table(spark, folder, "nation").select("n_nationkey", meta.alias("m"), F.round(w, 4).alias("width")).select("n_nationkey", F.col("m")["title"].alias("title"), F.col("m")["author"].alias("author"), "width")


@query("SELECT doc_id, sha256(nfc_normalize(replace(replace(t, chr(7), chr(65533)), chr(133), chr(65533)))) AS digest, 2 AS broken FROM (SELECT doc_id, chr(7) || text || 'e' || chr(769) || chr(133) AS t FROM documents)")
def sanitize_text(spark: SparkSession, folder: str) -> DataFrame:
    t = F.concat(F.lit("\x07"), F.col("text"), F.lit("é\x85"))
    return table(spark, folder, "documents").select("doc_id", F.sha2(sanitize.composed(sanitize.repaired(t)), 256).alias("digest"), sanitize.broken_count(t).alias("broken"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN n_nationkey + 0.5 END AS x FROM nation")
def lossless_numbers(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("n_nationkey")
    x = F.when(k % 3 == 0, F.lit(float("nan"))).when(k % 3 == 1, k + 0.5).otherwise(F.lit(-0.0))
    return table(spark, folder, "nation").select("n_nationkey", sanitize.lossless(x).alias("x"))
