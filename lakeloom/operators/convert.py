"""Conversions between models, and models to the bytes of a target format."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.blocks import BLOCK, SLIDE, runs_text
from lakeloom.sources.files import CELL, SHEET


def _cells(row: Column) -> Column:
    return F.transform(row, lambda v: F.struct(F.coalesce(v, F.lit("")).alias("v"), F.lit("s").alias("t"), F.lit(None).cast("string").alias("f")))


def document_to_workbook(blocks: Column) -> Column:
    """Each table is a sheet; without tables, one column of the texts."""
    tables = F.filter(blocks, lambda b: b["type"] == "table")
    sheets = F.transform(tables, lambda b, i: F.struct(F.concat(F.lit("表"), (i + 1).cast("string")).alias("name"), F.transform(b["rows"], _cells).alias("rows")))
    texts = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.transform(b["items"], lambda i: i["text"]), F.array(F.coalesce(b["text"], runs_text(b["runs"]), F.lit(""))))))
    column = F.transform(F.filter(texts, lambda t: F.trim(t) != ""), lambda t: _cells(F.array(t)))
    return F.when(F.size(tables) > 0, sheets).otherwise(F.array(F.struct(F.lit("Sheet1").alias("name"), column.alias("rows")))).cast(f"array<{SHEET}>")


def _block(kind: str, **values: Column) -> Column:
    import re

    fields = dict(re.findall(r"(type|level|text|ordered|header|items|rows|runs|alt|name):((?:[^,<]|<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)+)", BLOCK[len("struct<") : -1]))
    return F.struct(*((F.lit(kind) if f == "type" else values.get(f, F.lit(None))).cast(t).alias(f) for f, t in fields.items()))


def workbook_to_document(sheets: Column) -> Column:
    """A heading and a table for each sheet."""
    rows = lambda s: F.transform(s["rows"], lambda r: F.transform(r, lambda c: c["v"]))
    return F.flatten(F.transform(sheets, lambda s: F.array(_block("heading", level=F.lit(2), text=s["name"]), _block("table", header=F.lit(True), rows=rows(s)))))


def slides_to_document(slides: Column) -> Column:
    """A heading for each slide, then what it has of subtitle, bullets, table and notes."""

    def one(s: Column) -> Column:
        runs = F.from_json(F.to_json(F.array(F.struct(s["subtitle"].alias("text")))), "array<struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,code:boolean,link:string>>")
        parts = F.array(
            _block("heading", level=F.lit(2), text=s["title"]), F.when(s["subtitle"].isNotNull(), _block("paragraph", runs=runs)),
            F.when(F.size(s["bullets"]) > 0, _block("list", ordered=F.lit(False), items=s["bullets"])), F.when(s["rows"].isNotNull(), _block("table", header=F.lit(True), rows=s["rows"])), F.when(s["notes"].isNotNull(), _block("quote", text=s["notes"])),
        )
        return F.filter(parts, lambda b: b.isNotNull())

    return F.flatten(F.transform(slides, one))


def slides_to_workbook(slides: Column) -> Column:
    head = _cells(F.array(*(F.lit(x) for x in ("序号", "标题", "要点", "备注"))))
    points = lambda s: F.array_join(F.transform(s["bullets"], lambda b: F.concat(F.lit("· "), b["text"])), "\n")
    rows = F.transform(slides, lambda s, i: _cells(F.array((i + 1).cast("string"), s["title"], points(s), F.coalesce(s["notes"], F.lit("")))))
    return F.array(F.struct(F.lit("Sheet1").alias("name"), F.concat(F.array(head), rows).alias("rows"))).cast(f"array<{SHEET}>")


def workbook_to_slides(sheets: Column, most: int = 20) -> Column:
    """A slide for each sheet with rows: its first rows, and a note of how many there are if more."""
    none = F.lit(None)
    rows = lambda s: F.transform(F.slice(s["rows"], 1, most), lambda r: F.transform(r, lambda c: c["v"]))
    note = lambda s: F.when(F.size(s["rows"]) > most, F.concat(F.lit("共 "), F.size(s["rows"]).cast("string"), F.lit(" 行")))
    one = lambda s: F.struct(F.lit("content").alias("layout"), s["name"].alias("title"), none.cast("string").alias("subtitle"), F.array().cast("array<struct<level:int,text:string>>").alias("bullets"), rows(s).alias("rows"), note(s).alias("notes"), F.lit(0).alias("images"))
    return F.transform(F.filter(sheets, lambda s: F.size(s["rows"]) > 0), one).cast(f"array<{SLIDE}>")


def workbook_markdown(sheets: Column) -> Column:
    """Sheets as Markdown tables, each under its name if there are several."""
    from lakeloom.functions.blocks import table_markdown

    rows = lambda s: F.transform(s["rows"], lambda r: F.transform(r, lambda c: c["v"]))
    body = lambda s: F.coalesce(table_markdown(rows(s)), F.lit("_(空表)_"))
    head = lambda s: F.when(F.size(sheets) > 1, F.concat(F.lit("## 工作表: "), s["name"], F.lit("\n\n"))).otherwise("")
    return F.array_join(F.transform(sheets, lambda s: F.concat(head(s), body(s))), "\n\n")


def slides_markdown(slides: Column) -> Column:
    """Numbered headings, bullets by level, tables, and notes as quotes."""
    from lakeloom.functions.blocks import table_markdown

    def one(s: Column, i: Column) -> Column:
        bullets = F.array_join(F.transform(s["bullets"], lambda b: F.concat(F.repeat(F.lit("  "), b["level"]), F.lit("- "), b["text"])), "\n")
        parts = F.array(F.concat(F.lit("## "), (i + 1).cast("string"), F.lit(". "), s["title"]), s["subtitle"], bullets, F.when(s["rows"].isNotNull(), table_markdown(s["rows"])), F.concat(F.lit("> "), F.replace(s["notes"], F.lit("\n"), F.lit("\n> "))))
        return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n\n")

    return F.array_join(F.transform(slides, one), "\n\n")


def long_cells(df: DataFrame, key: str, sheets: str = "sheets") -> DataFrame:
    """Workbooks as rows: key, sheet, row, col, v, t, f."""
    one = df.select(key, F.explode(sheets).alias("s")).select(key, F.col("s.name").alias("sheet"), F.posexplode("s.rows").alias("row", "cells"))
    return one.select(key, "sheet", "row", F.posexplode("cells").alias("col", "c")).select(key, "sheet", "row", "col", "c.v", "c.t", "c.f")


def _filled(places: str, place: str, value: str, gap: Column) -> Column:
    """The values of a sorted array of (place, value) at their places from 0, with ``gap`` where there is none.
    Each element looks at the one before it, so the work grows with the length of what comes out."""

    def at(x: Column, i: Column) -> Column:
        last = F.coalesce(F.get(places, i - 1)[place], F.lit(-1))
        wrong = F.raise_error(F.concat(F.lit(f"two cells have the same {place}, or one has none: "), F.coalesce(x[place].cast("string"), F.lit("null")))).cast("int")
        return F.concat(F.array_repeat(gap, F.when(x[place] > last, x[place] - last - 1).otherwise(wrong)), F.array(x[value]))

    return F.flatten(F.transform(places, at))


def wide_sheets(cells: DataFrame, key: str) -> DataFrame:
    """The inverse: key and sheets; gaps become empty cells. Sheets come in the order of their names."""
    empty = F.struct(F.lit("").alias("v"), F.lit("s").alias("t"), F.lit(None).cast("string").alias("f"))
    line = cells.groupBy(key, "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", F.struct("v", "t", "f").alias("c")))).alias("m"))
    line = line.select(key, "sheet", "row", _filled("m", "col", "c", empty).alias("cells"))
    sheet = line.groupBy(key, "sheet").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("m"))
    rows = _filled("m", "row", "cells", F.array().cast(f"array<{CELL}>"))
    return sheet.select(key, F.struct(F.col("sheet").alias("name"), rows.alias("rows")).alias("s")).groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("sheets"))


def table_lines(df: DataFrame, key: str, row: str, cells: list[str], sep: str = " | ") -> DataFrame:
    """key and body: the rows of each key as lines of joined cells."""
    line = F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells))
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))


def csv_field(v: Column) -> Column:
    s = F.coalesce(v.cast("string"), F.lit(""))
    return F.when(s.rlike(r'^\s|\s$|[,"\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def first_rows(df: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each key, and total: how many it has."""
    w = Window.partitionBy(*key).orderBy(*order)
    total = df.groupBy(*key).agg(F.count("*").alias("total"))
    return df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).join(total, key)


def render(found: DataFrame, target: str) -> DataFrame:
    """path, content, images and error: each model as bytes of docx, odt, html, pdf, md, txt, xlsx, ods, csv, tsv,
    pptx, odp or json, and how many pictures the target could only name.

    Models of another kind are converted first; Markdown, text and JSON take each kind as it is.
    """
    kind = {"docx": "blocks", "odt": "blocks", "html": "blocks", "pdf": "blocks", "xlsx": "sheets", "ods": "sheets", "csv": "sheets", "tsv": "sheets", "pptx": "slides", "odp": "slides", "md": None, "txt": None, "json": None}[target]
    from lakeloom.functions.blocks import degrade_images, to_markdown, to_slides, to_text

    if kind is None:
        ready = found.where("error IS NULL")
        if target == "json":
            body = F.to_json(F.struct(F.col("model").alias("kind"), "meta", "blocks", "sheets", "slides"), {"pretty": "true", "ignoreNullFields": "true"})
        else:
            body = F.coalesce(to_markdown(F.col("blocks")), workbook_markdown(F.col("sheets")), slides_markdown(F.col("slides")))
            if target == "txt":
                body = F.coalesce(to_text(F.col("blocks")), stripped(body))
        return ready.select("path", F.encode(body, "utf-8").alias("content"), F.lit(0).alias("images"), F.lit(None).cast("string").alias("error"))

    forms = {
        "blocks": F.coalesce("blocks", workbook_to_document(F.col("sheets")), slides_to_document(F.col("slides"))),
        "sheets": F.coalesce("sheets", document_to_workbook(F.col("blocks")), slides_to_workbook(F.col("slides"))),
        "slides": F.coalesce("slides", to_slides(F.col("blocks")), workbook_to_slides(F.col("sheets"))),
    }
    if kind == "blocks":
        forms[kind], images = degrade_images(forms[kind])
    else:
        images = F.coalesce(degrade_images(F.col("blocks"))[1], F.lit(0))
    ready = found.where("error IS NULL").select("path", "meta", forms[kind].alias("model"), images.alias("images"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [attempt(m, dict(x) if x is not None else {}) for m, x in zip(b["model"], b["meta"])]
            yield pd.DataFrame({"path": b["path"], "content": [x[0] for x in made], "images": b["images"], "error": [x[1] for x in made]})

    def attempt(model, meta: dict) -> tuple[bytes | None, str | None]:
        try:
            return write(target, model, meta), None
        except Exception as e:  # noqa: BLE001  a model that cannot be written is a row, not a failed job
            return None, (str(e) or type(e).__name__)[:200]

    return ready.mapInPandas(run, "path string, content binary, images int, error string")


def stripped(markdown: Column) -> Column:
    """Markdown's headings, bold marks, table rules and escaped bars as plain text."""
    out = F.regexp_replace(markdown, r"(?m)^#{1,6} ", "")
    out = F.regexp_replace(out, r"(?m)^\|(?: ?-{3,} ?\|)+\n?", "")
    return F.replace(F.replace(out, F.lit("**"), F.lit("")), F.lit("\\|"), F.lit("|"))


def edit(files: DataFrame, edits: list[dict]) -> DataFrame:
    """path, content, counts and error: each package (path, content) after the same edits, see ``repack``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from lakeloom.sources import repack

        for b in batches:
            rows = []
            for name, data in zip(b["path"], b["content"]):
                try:
                    rows.append((name, *repack.apply(bytes(data), name, edits), None))
                except Exception as e:  # noqa: BLE001  a failed file is a row, not a failed job
                    rows.append((name, None, None, str(e)[:200] or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "content", "counts", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, counts array<int>, error string")


def publish(files: DataFrame, folder: str, overwrite: bool = True, waits: tuple[float, ...] = (0.06, 0.12, 0.18)) -> DataFrame:
    """Writes rows (path, content) as files below a folder that every machine mounts; gives path, size and
    error of each.

    A file is written beside its place, forced to disk and renamed into it, so no reader sees half of one;
    a rename that the system refuses for the moment is tried again after each of ``waits``. A task that is
    run again replaces what it has written. Failures are rows; they do not stop the others.
    """

    def place(name: str, data: bytes) -> str | None:
        path = os.path.normpath(os.path.join(folder, name))
        if os.path.isabs(name) or not path.startswith(os.path.normpath(folder) + os.sep):
            return "a path that leaves the folder"
        if not overwrite and os.path.exists(path):
            return "the file is there already"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        try:
            with open(beside, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            for wait in (*waits, None):
                try:
                    os.replace(beside, path)
                    return None
                except PermissionError:
                    if wait is None:
                        raise
                    time.sleep(wait)
        finally:
            if os.path.exists(beside):
                os.remove(beside)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = []
            for name, data in zip(b["path"], b["content"]):
                try:
                    errors.append("no content" if data is None else place(name, bytes(data)))
                except OSError as e:
                    errors.append(str(e)[:200])
            yield pd.DataFrame({"path": b["path"], "size": [len(x) if x is not None else 0 for x in b["content"]], "error": errors})

    return files.select("path", "content").mapInPandas(run, "path string, size long, error string")


def write(target: str, model, meta: dict) -> bytes:
    """One model as bytes."""
    from lakeloom.sources import plain, sheetlike, slidelike, wordlike

    model = _plain(model)
    if target in ("csv", "tsv"):
        rows = []
        for s in model:
            rows += [[f"# {s['name']}"]] if len(model) > 1 else []
            rows += [[c["v"] for c in r] for r in s["rows"]]
        return plain.delimited(rows) if target == "csv" else plain.delimited(rows, "\t", False)
    if target in ("html", "pdf"):
        from lakeloom.sources import page, pdf

        if target == "html":
            return page.render(model, meta).encode()
        data = pdf.write(model, meta)
        if why := pdf.gate(data, "".join(_texts(model))):
            raise ValueError(f"the PDF does not hold the text: {why[0]}")
        return data
    writers = {"docx": wordlike.write_docx, "odt": wordlike.write_odt, "xlsx": sheetlike.write_xlsx, "ods": sheetlike.write_ods, "pptx": slidelike.write_pptx, "odp": slidelike.write_odp}
    return writers[target](model, meta)


def _texts(blocks: list[dict]) -> Iterator[str]:
    """The texts that a page must show."""
    for b in blocks:
        yield b["text"] if b["text"] is not None else "".join(r["text"] for r in b["runs"] or [])
        yield from (i["text"] for i in b["items"] or [])
        yield from (c for r in b["rows"] or [] for c in r if c)


def _plain(x):
    """Lists and dicts of what Arrow and pandas have made of a model, which has no fractions: whole numbers
    come as such beside nulls."""
    if isinstance(x, float):
        return None if x != x else int(x)
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if hasattr(x, "tolist") and getattr(x, "ndim", 0):
        x = x.tolist()
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x
