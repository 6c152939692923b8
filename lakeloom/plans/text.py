"""Queries over texts: quality, inventory, ranges and pagination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import textstats as stats
from lakeloom.operators import ranges
from lakeloom.sources.tables import table

INLINE_CAP = 2000  # characters of a read; small, so that texts of the tables need several
GARBLED = ("\ue0a1", "\ufffd", "\x01", "\u00c3\u00c2", "\u2502", "bcdfghjklm ", "\u6570\u636e\u6587\u672c\u5185\u5bb9\u5f88\u957f", "0123456789", "a\n")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, and one text a nation that some test takes for garbled: the tables have none. Two kinds
    share a source whose other texts are Chinese."""
    key = F.col("n_nationkey")
    kind = F.element_at(F.lit(list(GARBLED)), (key % len(GARBLED) + 1).cast("int"))
    odd = table(spark, folder, "nation").select((-1 - key).cast("long").alias("doc_id"), F.repeat(kind, F.lit(60)).alias("text"), F.when((key % len(GARBLED)).isin(6, 7), "chinese").otherwise("garbled").alias("source"))
    return table(spark, folder, "documents").select("doc_id", "text", "source").union(odd)


_KINDS = ", ".join("concat(" + ", ".join(f"chr({ord(c)})" for c in g) + ")" for g in GARBLED)
DOCUMENTS = f"(SELECT doc_id, text, source FROM documents UNION ALL SELECT -1 - n_nationkey, repeat(list_extract([{_KINDS}], n_nationkey % {len(GARBLED)} + 1), 60), CASE WHEN n_nationkey % {len(GARBLED)} IN (6, 7) THEN 'chinese' ELSE 'garbled' END FROM nation)"


def _counted(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    return stats.counted(_documents(spark, folder), "text", "doc_id", *keep)


def _sql_counters() -> str:
    cells = ["length(regexp_replace(regexp_replace(t, '\\.{3,}', '', 'g'), '[ \\t\\n\\r]+', '', 'g')) AS visible"]
    cells += [f"length(regexp_replace(t, '[^{c}]+', '', 'g')) AS {name}" for name, c in stats.CLASSES.items()]
    runs = "CAST(coalesce(list_sum(list_transform(regexp_extract_all(t, '[{0}]{{{1},}}'), lambda x: length(x))), 0) AS BIGINT) AS {2}"
    cells += [runs.format("A-Za-z", 6, "letter_runs"), runs.format(stats.CONSONANT, 8, "no_vowel")]
    return ", ".join(cells)


COUNTED = f"WITH d AS (SELECT *, coalesce(text, '') AS t FROM {DOCUMENTS}), c AS (SELECT doc_id, source, t, {_sql_counters()} FROM d)"
ABSOLUTE = {
    "replacement": "visible >= 40 AND replacement >= 0.02 * visible",
    "private_use": "visible >= 40 AND private_use >= 0.02 * visible",
    "control": "visible >= 40 AND control >= 0.05 * visible",
    "odd_latin": "visible >= 40 AND odd_latin >= 0.5 * visible",
    "odd_box": "visible >= 40 AND odd_box >= 0.3 * visible",
    "no_vowel": "visible >= 40 AND ascii_letter >= 60 AND letter_runs > 0 AND no_vowel / letter_runs >= 0.25",
}
ANY = " OR ".join(f"({x})" for x in ABSOLUTE.values())


def quality_counters(spark: SparkSession, folder: str) -> DataFrame:
    return _counted(spark, folder)


def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    tests = stats.absolute()
    reason = F.array_join(F.array_sort(F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull())), ",")
    return _counted(spark, folder).select("doc_id", reason.alias("reasons")).select("doc_id", (F.col("reasons") != "").alias("garbled"), "reasons")


def quality_relative(spark: SparkSession, folder: str) -> DataFrame:
    """Each document against its source's ratios. The ratios are aggregated before they meet the
    documents: a source may hold a third of the rows, and sources are few."""
    rows = _counted(spark, folder, "source")
    base = rows.groupBy("source").agg(F.sum("cjk").alias("c"), F.sum(stats.odd()).alias("o"), F.sum("visible").alias("v"))
    base = base.select("source", stats.share("c", "v").alias("base_cjk"), stats.share("o", "v").alias("base_odd"))
    tests = stats.relative(F.col("base_cjk"), F.col("base_odd"))
    return rows.join(base, "source").select("doc_id", *(t.alias(k) for k, t in tests.items()))


def quality_repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = _documents(spark, folder).select("doc_id", stats.repeated_lines(F.col("text")).alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", "lines", "repeated", ((F.col("lines") >= 10) & (2 * F.col("repeated") >= F.col("lines"))).alias("garbled"))


def quality_short_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = _documents(spark, folder).select("doc_id", stats.short_lines(F.col("text")).alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", "lines", "short", ((F.col("lines") >= 12) & (4 * F.col("short") >= 3 * F.col("lines"))).alias("garbled"))


def quality_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: tested and garbled documents and the first three garbled ids."""
    garbled = F.lit(False)
    for t in stats.absolute().values():
        garbled = garbled | t
    rows = _counted(spark, folder, "source").where("visible > 0").select("source", "doc_id", garbled.alias("g"))
    first = rows.where("g").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("k <= 3")
    named = first.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("first_garbled"))
    total = rows.groupBy("source").agg(F.count("*").alias("tested"), F.count_if("g").alias("garbled"))
    return total.join(named, "source", "left").select("source", "tested", "garbled", F.coalesce("first_garbled", F.lit("")).alias("first_garbled"))


def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rounded ratios of each document."""
    names = {"cjk": "visible", "ascii_letter": "visible", "odd_latin": "visible", "no_vowel": "letter_runs"}
    return _counted(spark, folder).select("doc_id", *((F.floor(stats.share(k, v) * 10000 + 0.5) / 10000).alias(f"{k}_ratio") for k, v in names.items()))


def inventory_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, characters, garbled documents, worst consonant share and read batches by source."""
    garbled = F.lit(False)
    for t in stats.absolute().values():
        garbled = garbled | t
    docs = _documents(spark, folder).select("source", "text", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    rows = stats.counted(docs, "text", "source", "chars")
    rows = rows.withColumn("batches", F.greatest(F.ceil(F.col("chars") / INLINE_CAP), F.lit(1)).cast("long"))
    return rows.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("chars").cast("long").alias("characters"), F.count_if(garbled).alias("garbled"),
        (F.floor(F.max(stats.share("no_vowel", "letter_runs")) * 10000 + 0.5) / 10000).alias("worst_no_vowel"), F.sum("batches").alias("batches"),
    )


def page_windows(spark: SparkSession, folder: str) -> DataFrame:
    return ranges.windows(table(spark, folder, "documents"), "doc_id", "text", 1000).select("doc_id", "start", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"), "next_start")


def boundary_cut(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.length(ranges.cut(F.col("text"), 500)).cast("long").alias("kept"), (F.length("text") > 500).alias("truncated"))


def boundary_preview(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", ranges.preview(F.lag("text").over(order), tail=True).alias("before"), ranges.preview(F.lead("text").over(order), tail=False).alias("after"))


def page_ranges(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").where("quality = 1").select((F.col("doc_id") % 10).alias("book"), F.floor(F.col("doc_id") / 10).cast("long").alias("page"))
    return ranges.compact(labels, "book", "page")


def expand_ranges(spark: SparkSession, folder: str) -> DataFrame:
    specs = table(spark, folder, "nation").select("n_nationkey", F.concat(F.col("n_nationkey").cast("string"), F.lit("-"), (F.col("n_nationkey") + 3).cast("string"), F.lit(" , 7,2~4"), F.lit(" x 900")).alias("spec"))
    return ranges.expand(specs, "n_nationkey", "spec", total=25)


def select_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of conversations that a page selection names: a semi-join with the expanded selection."""
    turns = table(spark, folder, "conversations").withColumn("page", F.col("turn") + 1)
    wanted = ranges.expand(spark.createDataFrame([(1, "1,3-4")], "k int, spec string"), "k", "spec", total=1000).select(F.col("n").alias("page"))
    return turns.join(F.broadcast(wanted), "page", "left_semi").select("conv_id", "turn", F.length("text").alias("size"))


def json_page_cap(spark: SparkSession, folder: str) -> DataFrame:
    """The longest run of first turns whose texts fit into 300 characters, one turn at least."""
    turns = table(spark, folder, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("conv_id", "turn", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.row_number().over(order).alias("k"))
    return rows.where((F.col("total") <= 300) | (F.col("k") == 1)).groupBy("conv_id").agg(F.count("*").alias("pages"), F.max("total").alias("size"))


def batch_plan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.greatest(F.ceil(F.length("text") / 300), F.lit(1)).cast("int").alias("pages"))
    return ranges.batches(docs.where("pages > 12"), "doc_id", "pages", 15)


def doc_sessionize(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of the user open a section, as page headings do."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, folder, "conversations").withColumn("section", F.sum((F.col("role") == "user").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("conv_id", "section").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.sum(F.length("text")).alias("size"))


def blanks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.length(ranges.blanks(F.concat(F.col("source"), F.lit(" ___ "), F.repeat(F.lit("_"), (F.col("doc_id") % 23).cast("int"))), "□")).alias("size"))


QUERIES = {f.__name__: f for f in (quality_counters, quality_gate, quality_relative, quality_repeated_lines, quality_short_lines, quality_profile, quality_report, inventory_by_source, page_windows, boundary_cut, boundary_preview, page_ranges, expand_ranges, select_pages, json_page_cap, batch_plan, doc_sessionize, blanks)}
_LINES = r"list_transform(string_split_regex(coalesce(text, ''), '\r?\n'), lambda x: regexp_replace(x, '^" + stats.EDGE + "|" + stats.EDGE + "$', '', 'g'))"
ORACLES = {
    "quality_counters": f"{COUNTED} SELECT * EXCLUDE (source, t) FROM c",
    "quality_gate": f"{COUNTED}, r AS (SELECT doc_id, array_to_string(list_sort(list_filter([{', '.join(f'''CASE WHEN {v} THEN '{k}' END''' for k, v in ABSOLUTE.items())}], lambda x: x IS NOT NULL)), ',') AS reasons FROM c) SELECT doc_id, reasons <> '' AS garbled, reasons FROM r",
    "quality_relative": f"{COUNTED}, b AS (SELECT source, sum(cjk) / nullif(sum(visible), 0) AS bc, sum(odd_latin + odd_script + odd_box) / nullif(sum(visible), 0) AS bo FROM c GROUP BY source) SELECT doc_id, visible >= 200 AND coalesce(bc, 0) > 0.3 AND cjk / nullif(visible, 0) < bc / 3 AND ascii_letter / nullif(visible, 0) < 0.5 AS low_cjk, visible >= 200 AND coalesce(bo, 0) < 0.03 AND (odd_latin + odd_script + odd_box) / nullif(visible, 0) >= 0.12 AS odd FROM c JOIN b USING (source)",
    "quality_repeated_lines": f"WITH l AS (SELECT doc_id, unnest({_LINES}) AS line FROM {DOCUMENTS}), m AS (SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) >= 4 AND regexp_matches(line, '{stats.WORDLIKE}') GROUP BY ALL), s AS (SELECT doc_id, sum(n) AS lines, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS repeated FROM m GROUP BY doc_id) SELECT doc_id, CAST(coalesce(lines, 0) AS INTEGER) AS lines, CAST(coalesce(repeated, 0) AS INTEGER) AS repeated, coalesce(lines, 0) >= 10 AND 2 * repeated >= lines AS garbled FROM {DOCUMENTS} LEFT JOIN s USING (doc_id)",
    "quality_short_lines": f"WITH l AS (SELECT doc_id, list_filter({_LINES}, lambda x: x <> '') AS ls FROM {DOCUMENTS}), s AS (SELECT doc_id, CAST(len(ls) AS INTEGER) AS lines, CAST(len(list_filter(ls, lambda x: length(x) <= 2 AND NOT regexp_matches(x, '^[0-9]+$'))) AS INTEGER) AS short FROM l) SELECT *, lines >= 12 AND 4 * short >= 3 * lines AS garbled FROM s",
    "quality_profile": f"{COUNTED}, g AS (SELECT source, doc_id, {ANY} AS g FROM c WHERE visible > 0), n AS (SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS first_garbled FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM g WHERE g) WHERE k <= 3 GROUP BY source) SELECT source, count(*) AS tested, count(*) FILTER (WHERE g) AS garbled, coalesce(any_value(first_garbled), '') AS first_garbled FROM g LEFT JOIN n USING (source) GROUP BY source",
    "quality_report": f"{COUNTED} SELECT doc_id, " + ", ".join(f"floor(CASE WHEN {v} > 0 THEN {k} / {v} ELSE 0 END * 10000 + 0.5) / 10000 AS {k}_ratio" for k, v in {"cjk": "visible", "ascii_letter": "visible", "odd_latin": "visible", "no_vowel": "letter_runs"}.items()) + " FROM c",
    "inventory_by_source": f"{COUNTED} SELECT source, count(*) AS documents, CAST(sum(length(t)) AS BIGINT) AS characters, count(*) FILTER (WHERE {ANY}) AS garbled, floor(max(CASE WHEN letter_runs > 0 THEN no_vowel / letter_runs ELSE 0 END) * 10000 + 0.5) / 10000 AS worst_no_vowel, CAST(sum(greatest(ceil(length(t) / {INLINE_CAP}), 1)) AS BIGINT) AS batches FROM c GROUP BY source",
    "page_windows": "WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1000)) AS start FROM documents) SELECT doc_id, start, length(substring(text, start + 1, 1000)) AS size, sha256(substring(text, start + 1, 1000)) AS digest, CASE WHEN start + 1000 < length(text) THEN start + 1000 END AS next_start FROM w",
    "boundary_cut": "WITH h AS (SELECT doc_id, text, left(text, 500) AS head FROM documents), p AS (SELECT *, CASE WHEN contains(head, chr(10)) THEN length(head) - strpos(reverse(head), chr(10)) ELSE -1 END AS pos FROM h) SELECT doc_id, CASE WHEN length(text) <= 500 THEN length(text) WHEN pos > 300 THEN pos ELSE 500 END AS kept, length(text) > 500 AS truncated FROM p",
    "boundary_preview": "WITH w AS (SELECT conv_id, turn, lag(text) OVER o AS b, lead(text) OVER o AS a FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)), c AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(b, ''), '\\s+', ' ', 'g')) AS b, trim(regexp_replace(coalesce(a, ''), '\\s+', ' ', 'g')) AS a FROM w) SELECT conv_id, turn, CASE WHEN length(b) > 100 THEN '…' || right(b, 100) ELSE b END AS before, CASE WHEN length(a) > 100 THEN left(a, 100) || '…' ELSE a END AS after FROM c",
    "page_ranges": "WITH p AS (SELECT DISTINCT doc_id % 10 AS book, doc_id // 10 AS page FROM labels WHERE quality = 1), g AS (SELECT *, page - row_number() OVER (PARTITION BY book ORDER BY page) AS k FROM p), r AS (SELECT book, min(page) AS lo, max(page) AS hi FROM g GROUP BY book, k) SELECT book, string_agg(CASE WHEN hi > lo THEN lo || '-' || hi ELSE CAST(lo AS VARCHAR) END, ',' ORDER BY lo) AS ranges FROM r GROUP BY book",
    "expand_ranges": "SELECT DISTINCT n_nationkey, CAST(n AS INTEGER) AS n FROM (SELECT n_nationkey, unnest(list_concat(range(n_nationkey, n_nationkey + 4), [7, 2, 3, 4])) AS n FROM nation) WHERE n BETWEEN 1 AND 25",
    "select_pages": "SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS size FROM conversations WHERE turn + 1 IN (1, 3, 4)",
    "json_page_cap": "WITH w AS (SELECT conv_id, sum(length(text)) OVER o AS total, row_number() OVER o AS k FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) SELECT conv_id, count(*) AS pages, CAST(max(total) AS BIGINT) AS size FROM w WHERE total <= 300 OR k = 1 GROUP BY conv_id",
    "batch_plan": "WITH d AS (SELECT doc_id, CAST(greatest(ceil(length(text) / 300), 1) AS INTEGER) AS pages FROM documents), b AS (SELECT doc_id, pages, unnest(range(1, pages + 1, 15)) AS first FROM d WHERE pages > 12) SELECT doc_id, CAST(first AS INTEGER) AS first_page, CAST(least(first + 14, pages) AS INTEGER) AS last_page FROM b",
    "doc_sessionize": "WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations) SELECT conv_id, CAST(section AS BIGINT) AS section, count(*) AS turns, min(turn) AS first_turn, CAST(sum(length(text)) AS BIGINT) AS size FROM s GROUP BY conv_id, section",
    "blanks": "SELECT doc_id, CAST(length(source) + 5 + CASE WHEN doc_id % 23 >= 3 THEN greatest(3, CAST(floor(0.6 * (doc_id % 23) + 0.5) AS INTEGER)) ELSE doc_id % 23 END AS INTEGER) AS size FROM documents",
}
