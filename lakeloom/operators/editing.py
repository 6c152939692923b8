"""Edits of texts and tables of cells. Each gives the edited rows; counts come as columns or frames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_text(text: Column, find: str, replacement: str, regex: bool = False) -> tuple[Column, Column]:
    """The text after replacement, which is literal even for a pattern, and the number of hits."""
    pattern = find if regex else re.escape(find)
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, pattern, literal), F.regexp_count(text, F.lit(pattern))


def replace_value(value: Column, find: str, replacement: str, whole: bool = True) -> Column:
    return F.when(value == find, replacement).otherwise(value) if whole else F.replace(value, F.lit(find), F.lit(replacement))


def append_text(text: Column, more: str) -> Column:
    return F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n" + more + "\n"))


def prepend_text(text: Column, more: str) -> Column:
    return F.concat(F.lit(more + "\n"), text)


def set_cells(cells: DataFrame, updates: DataFrame) -> DataFrame:
    """Cells (sheet, row, col, v) with the updates put in place or added."""
    keys = ["sheet", "row", "col"]
    return cells.join(updates, keys, "left_anti").unionByName(updates)


def append_rows(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Puts rows (sheet, row from 0, col, v) below the last row of their sheet."""
    last = cells.groupBy("sheet").agg(F.max("row").alias("__last"))
    placed = rows.join(last, "sheet", "left").withColumn("row", F.col("row") + F.coalesce("__last", F.lit(-1)) + 1).drop("__last")
    return cells.unionByName(placed)


def add_sheet(sheets: DataFrame, name: str) -> DataFrame:
    """sheets (pos, sheet): one more at the end; the name is cut to 31 characters."""
    last = sheets.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("pos")).withColumn("sheet", F.lit(name[:31]))
    return sheets.unionByName(last)


def rename_sheet(sheets: DataFrame, old: str, new: str) -> DataFrame:
    if not sheets.where(F.col("sheet") == old).limit(1).count():
        raise ValueError(f"no sheet {old!r}")
    return sheets.withColumn("sheet", F.when(F.col("sheet") == old, new[:31]).otherwise(F.col("sheet")))


def delete_sheet(sheets: DataFrame, name: str) -> DataFrame:
    if sheets.limit(2).count() < 2:
        raise ValueError("a workbook keeps one sheet at least")
    return sheets.where(F.col("sheet") != name)


def set_meta(meta: Column, values: dict[str, str]) -> Column:
    """A map with the values put in place or added."""
    new = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.map_concat(F.map_filter(meta, lambda k, v: ~k.isin(*values)), new)


def append_blocks(blocks: Column, more: Column) -> Column:
    return F.concat(blocks, more)


def insert_after(blocks: Column, anchor: str, block: Column) -> tuple[Column, Column]:
    """The block after the first paragraph with the anchor, else at the end; and whether it was found."""
    at = F.coalesce(F.array_min(F.filter(F.transform(blocks, lambda b, i: F.when((b["type"] == "paragraph") & b["text"].contains(anchor), i)), lambda i: i.isNotNull())), F.lit(-1))
    place = F.when(at < 0, F.size(blocks)).otherwise(at + 1)
    return F.concat(F.slice(blocks, F.lit(1), place), F.array(block), F.slice(blocks, place + 1, F.greatest(F.size(blocks) - place, F.lit(0)))), at >= 0


def image_points(width: Column, height: Column, most: float = 451.3) -> tuple[Column, Column]:
    """Pixels to points, shrunk in proportion where wider than the page allows."""
    w, h = width * 72 / 96, height * 72 / 96
    scale = F.least(F.lit(1.0), most / w)
    return w * scale, h * scale


def update_slide(slides: Column, index: int, title: str | None = None, subtitle: str | None = None) -> Column:
    """The slide at an index from 1 with the given fields overridden."""
    change = lambda s: s.withField("title", F.lit(title) if title is not None else s["title"]).withField("subtitle", F.lit(subtitle) if subtitle is not None else s["subtitle"])
    return _within(slides, index, F.transform(slides, lambda s, i: F.when(i == index - 1, change(s)).otherwise(s)))


def delete_slide(slides: Column, index: int) -> Column:
    """Without the slide at an index from 1; an error for the only slide."""
    rest = F.filter(slides, lambda s, i: i != index - 1)
    return _within(slides, index, F.when(F.size(slides) > 1, rest).otherwise(F.raise_error(F.lit("a deck keeps one slide at least"))))


def add_slide(slides: Column, slide: Column) -> Column:
    return F.concat(slides, F.array(slide))


def _within(slides: Column, index: int, result: Column) -> Column:
    return F.when((F.size(slides) >= index) & (F.lit(index) >= 1), result).otherwise(F.raise_error(F.concat(F.lit(f"no slide {index} among "), F.size(slides).cast("string"))))


def number_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("row", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
