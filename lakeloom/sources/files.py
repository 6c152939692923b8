"""Office files as tables: one row a file, one model of three kinds, failures as values.

``read`` gives kind, meta, blocks (text documents), sheets (workbooks), slides (decks) and error. A file
is the unit of work; it never leaves its task, and a file that cannot be read does not fail the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.blocks import BLOCK, SLIDE, block, run

CELL = "struct<v:string,t:string,f:string>"
SHEET = f"struct<name:string,rows:array<array<{CELL}>>>"
MODEL = f"format string, model string, meta map<string,string>, blocks array<{BLOCK}>, sheets array<{SHEET}>, slides array<{SLIDE}>, error string"
EXTENSIONS = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "doc", "wps", "xls", "et", "ppt", "dps", "csv", "tsv", "md", "markdown", "html", "htm", "txt", "json", "jsonl", "rtf", "pdf")


def load(data: bytes | None, name: str) -> dict:
    """The model of one file."""
    from lakeloom.sources import markdown, markup, package, plain, sheetlike, slidelike, wordlike

    out = {"format": None, "model": None, "meta": {}, "blocks": None, "sheets": None, "slides": None, "error": None}
    if data is None:
        return out | {"error": "no content"}
    try:
        kind = out["format"] = package.sniff(data, name)
        if kind in ("docx", "odt"):
            out["model"] = "document"
            out["blocks"], out["meta"] = (wordlike.read_docx if kind == "docx" else wordlike.read_odt)(data)
        elif kind in ("xlsx", "ods"):
            out["model"], out["sheets"] = "workbook", (sheetlike.read_xlsx if kind == "xlsx" else sheetlike.read_ods)(data)
        elif kind in ("pptx", "odp"):
            out["model"], out["slides"] = "slides", (slidelike.read_pptx if kind == "pptx" else slidelike.read_odp)(data)
        elif kind == "ole2":
            from lakeloom.sources import legacy

            parts = legacy.streams(data)
            kind = out["format"] = legacy.kind(parts)
            out["model"] = {"doc": "document", "xls": "workbook", "ppt": "slides"}[kind]
            if kind == "doc":
                out["blocks"] = [block("paragraph", runs=[run(x.strip())]) for x in legacy.doc_text(parts).splitlines() if x.strip()]
            elif kind == "xls":
                out["sheets"] = legacy.sheets(parts)
            else:
                out["slides"] = legacy.slides(parts)
        elif kind in ("csv", "tsv"):
            rows = plain.rows(plain.decode(data), "\t" if kind == "tsv" else None)
            out["model"], out["sheets"] = "workbook", [{"name": "Sheet1", "rows": [[sheetlike.cell(c, inferred(c)) for c in r] for r in rows]}]
        elif kind == "md":
            out["model"], out["blocks"] = "document", markdown.parse(plain.decode(data))
        elif kind == "html":
            out["model"] = "document"
            out["blocks"], out["meta"] = markup.parse(plain.decode(data))
        elif kind == "pdf":
            from lakeloom.sources import pdf

            pages = pdf.read(data)
            out["model"] = "document"
            out["meta"] = _layer([p["text"] for p in pages])
            out["blocks"] = [b for p in pages for b in (block("heading", level=2, text=f"第 {p['page']} 页"), *markdown.parse(p["text"]))]
        elif kind in ("rtf", "text"):
            text = plain.rtf(data) if kind == "rtf" else plain.decode(data)
            out["model"], out["blocks"] = "document", [block("paragraph", runs=[run(x.strip())]) for x in text.splitlines() if x.strip()]
        else:
            raise package.Refused(f"no reader for {kind}")
    except Exception as e:  # noqa: BLE001  a failed file is a row, not a failed job
        out["error"] = (str(e) or type(e).__name__).splitlines()[0][:200]
    return out


def _layer(pages: list[str]) -> dict[str, str]:
    """What a text layer is worth: numbers of pages, of those without text and of garbled ones, and these."""
    from lakeloom.functions import textstats

    bad = [k for k, g in enumerate(textstats.garbled(textstats.count(pages)), 1) if g] if pages else []
    return {"pages": str(len(pages)), "scanned": str(sum(not p.strip() for p in pages)), "garbled": str(len(bad)), "garbled_pages": _ranges(bad)}


def _ranges(numbers: list[int]) -> str:
    out: list[list[int]] = []
    for n in numbers:
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return ",".join(f"{a}-{b}" if b > a else str(a) for a, b in out)


def inferred(value: str) -> str:
    """The kind of a text cell: a number unless it has a leading zero before a digit."""
    import re

    return "n" if re.fullmatch(r"-?(?!0\d)\d+(\.\d+)?([eE][-+]?\d+)?", value) else "s"


def _pieces(b: pd.DataFrame, most: int, rows: int) -> Iterator[pd.DataFrame]:
    """A batch of files in pieces of so many bytes, but for a larger file, and so many rows."""
    start = size = 0
    for k, c in enumerate(b["content"]):
        n = 0 if c is None else len(c)
        if k > start and (size + n > most or k - start == rows):
            yield b.iloc[start:k]
            start, size = k, 0
        size += n
    if len(b):
        yield b.iloc[start:]


def models(files: DataFrame, piece: int = 1_000_000, rows: int = 200) -> DataFrame:
    """path and the model of each row of (path, content). A model takes many times the memory of its file,
    so a task holds those of a piece of its batch at once."""

    def run_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _pieces(b, piece, rows):
                found = pd.DataFrame([load(None if c is None else bytes(c), p) for p, c in zip(part["path"], part["content"])], columns=["format", "model", "meta", "blocks", "sheets", "slides", "error"])
                found.insert(0, "path", part["path"].to_numpy())
                yield found

    return files.select("path", "content").mapInPandas(run_, f"path string, {MODEL}")


def read(spark: SparkSession, folder: str, most: int | None = 500) -> DataFrame:
    """The models of a folder's files with a supported extension, the first ``most`` by path; the same path
    in another case once. ``summary`` says whether there are more."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS) & ~F.lower("path").rlike(r"\.(ocr\.md|ocr\.json|read\.md)$"))
    first = files.select("path").groupBy(F.lower("path").alias("low")).agg(F.min("path").alias("path")).select("path")
    if most is not None:
        first = first.orderBy("path").limit(most)
    return models(files.join(first, "path", "left_semi"))


def inventory(found: DataFrame, cap: int = 120_000) -> DataFrame:
    """One row a file: format, counts, characters, titles, pages and what its text layer is worth, batches to
    read it in, error."""
    from lakeloom.functions.blocks import sheet_stats, slide_stats, stats

    cells = F.flatten(F.flatten(F.transform("sheets", lambda s: s["rows"])))
    of_slides = F.aggregate("slides", F.lit(0), lambda a, s: a + F.length(F.coalesce(s["title"], F.lit(""))) + F.aggregate(s["bullets"], F.lit(0), lambda b, i: b + F.length(i["text"])))
    chars = F.coalesce(stats(F.col("blocks"))["characters"], F.aggregate(cells, F.lit(0), lambda a, c: a + F.length(c["v"])), of_slides, F.lit(0))
    titles = F.coalesce(stats(F.col("blocks"))["titles"], slide_stats(F.col("slides"))["titles"])
    noted = F.array_join(F.transform(sheet_stats(F.col("sheets")), lambda s: F.concat(s["name"], F.lit(":"), s["rows"].cast("string"), F.lit("行"))), "、")
    number = lambda k: F.col("meta")[k].cast("int")
    rows = found.select(
        "path", "format", F.size("blocks").alias("blocks"), F.size("sheets").alias("sheets"), F.size("slides").alias("slides"), chars.alias("characters"), titles.alias("titles"),
        F.coalesce(number("pages"), F.size("slides")).alias("pages"), F.coalesce(number("scanned"), F.lit(0)).alias("scanned"), F.coalesce(number("garbled"), F.lit(0)).alias("garbled"),
        F.coalesce(F.col("meta")["garbled_pages"], F.lit("")).alias("garbled_pages"), F.coalesce(noted, F.lit("")).alias("notes"), "error",
    )
    pdf = F.when(F.col("garbled") > 0, F.ceil(F.col("pages") / 20)).when(F.col("pages") > 12, F.ceil(F.col("pages") / 15)).otherwise(1)
    batches = F.when(F.col("format") == "pdf", pdf).otherwise(F.ceil(F.col("characters") / cap))
    usable = F.col("error").isNull() & (F.col("garbled") == 0) & ((F.col("format") != "pdf") | (F.col("scanned") < F.col("pages")))
    return rows.withColumn("usable", usable).withColumn("batches", F.greatest(batches, F.lit(1)).cast("int"))


def summary(rows: DataFrame, there: int | None = None, skipped: int = 0) -> DataFrame:
    """One row of an inventory: total, ok, failed, skipped, whether files were left out (``there``: how many
    there are), characters, batches, and the garbled files with their pages."""
    named = F.array_sort(F.collect_list(F.when(F.col("garbled") > 0, F.concat(F.col("path"), F.lit("（第 "), "garbled_pages", F.lit(" 页）")))))
    total = rows.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("ok"), F.count("error").alias("failed"), F.sum("characters").alias("characters"), F.sum("batches").alias("batches"), F.array_join(named, "、").alias("garbled"))
    return total.withColumn("skipped", F.lit(skipped)).withColumn("truncated", F.lit(there or 0) > F.col("total"))


def markdown_table(rows: DataFrame) -> DataFrame:
    """One row, one column: an inventory as a Markdown table in the order of paths. An inventory is bounded
    by what one scan reads."""
    safe = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("—")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")
    bad = F.concat(F.col("garbled").cast("string"), F.when(F.col("garbled_pages") != "", F.concat(F.lit("（"), "garbled_pages", F.lit("）"))).otherwise(""))
    fine = F.array(safe("path"), safe("format"), safe("pages"), safe("characters"), F.when(F.col("usable"), "✓").otherwise("✗"), safe("scanned"), bad, safe("batches"), safe("notes"))
    failed = F.array(safe("path"), *[F.lit("—")] * 7, F.concat(F.lit("❌ "), safe("error")))
    line = F.concat(F.lit("| "), F.array_join(F.when(F.col("error").isNull(), fine).otherwise(failed), " | "), F.lit(" |"))
    # The table's head.
    head = "| 文件 | 格式 | 页 | 字符 | 文字层 | 扫描页 | 乱码页 | 建议批次 | 备注 |\n| --- | --- | ---: | ---: | --- | ---: | ---: | ---: | --- |"
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"])
    return rows.agg(F.array_join(F.concat(F.array(F.lit(head)), lines), "\n").alias("table"))
